"""String functions: ``Column -> Column``, all built from JVM-side expressions.

Every function passes SQL NULL through unchanged, like the reference's
``pd.NA`` handling.  Regexes are written so that Java (Spark) and RE2
(DuckDB, used by the oracle queries) read them the same way: explicit
character classes, ``\\x{...}`` code points, ``\\A``/``\\z`` anchors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# These must equal the reference's for equal results.
# --------------------------------------------------------------------------

# Characters of the single-pass cleaner, as the reference lists its ranges.
CJK_RANGES_SINGLE_PASS = [
    (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303F), (0x3400, 0x4DBF),
    (0x4E00, 0x9FA5), (0x9FA6, 0x9FBB), (0x9FBC, 0x9FC3), (0x9FC4, 0x9FCB),
    (0x9FCC, 0x9FCC), (0x9FCD, 0x9FD5), (0x9FD6, 0x9FEA), (0x9FEB, 0x9FEF),
    (0x9FF0, 0x9FFC), (0x9FFD, 0x9FFF),
]

# Characters of the fixpoint cleaner: ranges, then single characters.
CJK_RANGES_FIXPOINT = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF),
    (0x30000, 0x323AF), (0xFA0E, 0xFA29),
]
CJK_SINGLES_FIXPOINT = "〆〇，。！？：；「」『』（）［］｛｝《》〈〉﹏﹋﹌﹏、‧・。～—…．"

# Bracket/slash folding, applied in this order.
BRACKET_FOLDS = [(" ( ", "（"), (" ) ", "）"), (" / ", "／")]

# Junk removal: words first (list order matters), then single characters.
JUNK_WORDS = ["f?", "Illi", "??", "****", "***", "**", "0p", "i~", "r?", "....", "T^"]
JUNK_CHARS = "皿屮彳•«口二匚^一|/=■—I|^—”■■ҽԖज़ϦљϷηϦљӝ଄!୍ൔ"

# Doc-id pattern categories and tag formats.
DOC_ID_CATEGORIES = ["insurance", "finance", "faq"]
ARTICLE_TAG = '<article id="{category}_{doc_num}">{content}</article>'
PAGE_TAG = '<page number="{page}">{text}</page>'
CONTEXT_TAG = "<context>{context}</context>"
PREDICTION_FILE = "qid{qid}_iter{iter}_checkpoint{checkpoint}.json"
LIST_SEPARATOR = "、"
LIST_LAST_SEPARATOR = "及"

# Python's notion of whitespace (``\\s`` in str patterns, ``str.strip()``).
WHITESPACE_CLASS = (r"\t\n\x0b\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# The same set as plain characters (for ``btrim``).
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")

# --------------------------------------------------------------------------


def _cp(c: int) -> str:
    return "\\x{%x}" % c


def char_class(ranges: Sequence[tuple[int, int]] = (), singles: str = "") -> str:
    """Regex character class (without brackets) from code-point ranges and
    single characters.  Members are sorted and adjacent/overlapping ones
    merged (the same set of characters, fewer members for the regex engine
    to test).  The constants above stay exactly as listed."""
    pts = sorted(set(ranges) | {(ord(ch), ord(ch)) for ch in singles})
    merged: list[tuple[int, int]] = []
    for a, b in pts:
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return "".join(_cp(a) if a == b else f"{_cp(a)}-{_cp(b)}" for a, b in merged)


CJK_SINGLE_PASS_CLASS = char_class(CJK_RANGES_SINGLE_PASS)
CJK_FIXPOINT_CLASS = char_class(CJK_RANGES_FIXPOINT, CJK_SINGLES_FIXPOINT)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def despace_cjk_once(text, cls: str = CJK_SINGLE_PASS_CLASS, max_gap: int = 4) -> Column:
    """drop 1..max_gap whitespace chars between two CJK chars, one
    left-to-right pass (in ``中 文 字`` every second gap survives)."""
    pat = f"([{cls}])[{WHITESPACE_CLASS}]{{1,{max_gap}}}([{cls}])"
    return F.regexp_replace(_c(text), pat, "$1$2")


def strip_space(text) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not just blanks).
    ``btrim`` with the explicit character set only looks at the two ends,
    unlike an anchored regex alternation that probes every position."""
    return F.btrim(_c(text), F.lit(WHITESPACE_CHARS))


def despace_cjk(text, cls: str = CJK_FIXPOINT_CLASS, max_gap: int = 4) -> Column:
    """the fixpoint of the gap removal, then strip.

    The reference loops ``sub`` until nothing changes.  Because the CJK class
    and whitespace are disjoint, one pass that keeps the right-hand char in a
    look-ahead reaches the same fixpoint (each merge leaves the right char
    free to start the next match)."""
    pat = f"([{cls}])[{WHITESPACE_CLASS}]{{1,{max_gap}}}(?=[{cls}])"
    return strip_space(F.regexp_replace(_c(text), pat, "$1"))


def drop_blank_lines(text) -> Column:
    """remove lines that are empty or whitespace only (``^\\s*$\\n``,
    multiline; ``\\n`` is the only line end, as in Python)."""
    return F.regexp_replace(_c(text), f"(?md)^[{WHITESPACE_CLASS}]*$\\n", "")


def fold_brackets(text, folds: Sequence[tuple[str, str]] = tuple(BRACKET_FOLDS)) -> Column:
    """``" ( "`` → ``（`` etc., in list order."""
    out = _c(text)
    for a, b in folds:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_text(text) -> Column:
    """blank lines → bracket folding → CJK despace to fixpoint → strip."""
    return despace_cjk(fold_brackets(drop_blank_lines(text)))


def remove_junk(text, words: Sequence[str] = tuple(JUNK_WORDS), chars: str = JUNK_CHARS) -> Column:
    """delete junk words in list order, then every junk character."""
    out = _c(text)
    for w in words:
        out = F.replace(out, F.lit(w), F.lit(""))
    if chars:
        out = F.translate(out, chars, "")
    return out


def clean_node_text(text) -> Column:
    """the cleaner applied to document-tree node text."""
    return remove_junk(clean_text(text))


def page_tag(page_no, text) -> Column:
    """F8: ``<page number="i">text</page>`` (well-formed; see README, Q1)."""
    return F.concat(F.lit('<page number="'), _c(page_no).cast("string"), F.lit('">'),
                    _c(text), F.lit("</page>"))


def article_tag(category, doc_num, content) -> Column:
    """``<article id="{category}_{doc_num}">content</article>``."""
    return F.concat(F.lit('<article id="'), _c(category), F.lit("_"),
                    _c(doc_num).cast("string"), F.lit('">'), _c(content), F.lit("</article>"))


def context_tag(context) -> Column:
    """``<context>…</context>``."""
    return F.concat(F.lit("<context>"), _c(context), F.lit("</context>"))


def join_cjk_list(arr) -> Column:
    """``[a]→a``, ``[a,b]→a及b``, ``[a,b,c]→a、b及c``; empty or null → null."""
    a = _c(arr)
    n = F.size(a)
    head = F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(1))), LIST_SEPARATOR)
    return (F.when(a.isNull() | (n <= 0), F.lit(None).cast("string"))
            .when(n == 1, F.get(a, 0))
            .otherwise(F.concat(head, F.lit(LIST_LAST_SEPARATOR), F.try_element_at(a, F.lit(-1)))))


def normalize_quotes(text) -> Column:
    """``「」`` → ``『』``."""
    return F.translate(_c(text), "「」", "『』")


def doc_id_pattern(categories: Sequence[str] = tuple(DOC_ID_CATEGORIES), whole_id: bool = False) -> str:
    alt = "|".join(categories)
    pat = f"(?:{alt})_\\p{{Nd}}+"  # any decimal digit, as in the reference
    if whole_id:
        pat += "(?!\\p{Nd})"
    return pat


def extract_doc_ids(text, categories: Sequence[str] = tuple(DOC_ID_CATEGORIES)) -> Column:
    """F16: every match of ``(cat1|cat2|…)_digits`` in order."""
    return F.regexp_extract_all(_c(text), F.lit(doc_id_pattern(categories)), 0)


def first_doc_id(text, categories: Sequence[str] = tuple(DOC_ID_CATEGORIES)) -> Column:
    """F16: first match, or null when there is none."""
    return F.try_element_at(extract_doc_ids(text, categories), F.lit(1))


def split_doc_id(doc_id) -> Column:
    """``faq_12`` → struct(category='faq', number='12')."""
    parts = F.split(_c(doc_id), "_", 2)
    return F.struct(F.get(parts, 0).alias("category"), F.get(parts, 1).alias("number"))


def render(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders of a literal template with columns; NULL in
    any of them gives NULL."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[_c(cols[p]).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def prediction_file_name(qid, iteration, checkpoint) -> Column:
    """``qid{q}_iter{i}_checkpoint{n}.json`` (per-batch prediction file)."""
    return render(PREDICTION_FILE, qid=qid, iter=iteration, checkpoint=checkpoint)
