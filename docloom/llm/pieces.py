"""A piece table from an existing SentencePiece model file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The public vocabulary; its path is a parameter everywhere.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: What a character outside the vocabulary costs beyond the
#: least likely piece; the offset of the rank law.
UNKNOWN_PENALTY, RANK_OFFSET = 10.0, 2.7
#: Scores below this are no scores: the piece is used (runs of blanks, mostly),
#: and its score follows from its place in the vocabulary.
NO_SCORE = -1e8


def load_pieces(model_file: str = MODEL_FILE) -> list[tuple[int, str, float]]:
    """(id, piece, natural log of the probability) of the ordinary pieces.

    Unigram files hold log-probabilities.  Where the scores are minus the rank
    (as in merge-trained files), a piece's probability follows its rank r as
    1 / (r + RANK_OFFSET).  A piece without a score has the rank of its place
    there, and the score between its neighbours' in a unigram file.
    Probabilities are normalised either way."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = np.array([s for _, _, s in rows])
    place, scored = np.arange(len(rows)), score > NO_SCORE
    ranks = score[scored].min() < -100
    score[~scored] = -place[~scored] if ranks else np.interp(place[~scored], place[scored], score[scored])
    if ranks:
        score = -np.log(-score + RANK_OFFSET)
    score -= np.log(np.exp(score - score.max()).sum()) + score.max()
    return [(i, p, float(s)) for (i, p, _), s in zip(rows, score, strict=True)]


def byte_ids(model_file: str = MODEL_FILE) -> list[int]:
    """Ids of the 256 byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def piece_table(spark: SparkSession, pieces: list[tuple[int, str, float]]) -> DataFrame:
    """piece, id, score: as many rows as the vocabulary has pieces."""
    return spark.createDataFrame(pieces, "id int, piece string, score double").select("piece", "id", F.col("score"))
