"""Shared pieces of the registered queries: SQL spellings of the text
cleaners for the oracles, the noisy-CJK document derivation, table helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from . import tables as TB


NL = "chr(10)"
WS = tx.WHITESPACE_CLASS
SQL_CJK = f"translate(text, '{TB.LATIN}', '{TB.CJK_26}')"
SQL_NOISY = f"replace(replace({SQL_CJK}, '. ', '.' || {NL} || ' ' || {NL}), ', ', ' ( ')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def _sql_despace_once(x: str) -> str:
    return _sql_pair_pass(x, tx.CJK_SINGLE_PASS_CLASS)


def _sql_pair_pass(x: str, cls: str) -> str:
    return f"regexp_replace({x}, '([{cls}])[{WS}]{{1,4}}([{cls}])', '\\1\\2', 'g')"


def _sql_blank_lines(x: str) -> str:
    return f"regexp_replace({x}, '(?m)^[{WS}]*$\\n', '', 'g')"


def _sql_fold(x: str) -> str:
    for a, b in tx.BRACKET_FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_fixpoint(x: str) -> str:
    # two nested single passes always reach the fixpoint (the second pass
    # removes the gaps the first left between merged pairs)
    c = tx.CJK_FIXPOINT_CLASS
    return _sql_strip(_sql_pair_pass(_sql_pair_pass(x, c), c))


def _sql_junk(x: str) -> str:
    for w in tx.JUNK_WORDS:
        x = f"replace({x}, '{w}', '')"
    return f"translate({x}, '{tx.JUNK_CHARS}', '')"


def _sql_clean(x: str) -> str:
    return _sql_fixpoint(_sql_fold(_sql_blank_lines(x)))


def noisy_cjk(col: str = "text"):
    """CJK-translated text with planted blank lines and spaced brackets."""
    return F.replace(F.replace(TB.cjk_text(col), F.lit(". "), F.lit(".\n \n")), F.lit(", "), F.lit(" ( "))


def _docs(spark, d, balanced: bool = True):
    """documents, dealt over the shuffle partitions when the query does heavy
    per-row work (regex, higher-order functions, Python hooks)."""
    return TB.table(spark, d, "documents", balanced=balanced)
