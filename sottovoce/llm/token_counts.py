"""Counts of unigram pieces without making the pieces.

An Aho-Corasick automaton over the vocabulary lists all matches in a word by their ends; dynamic programming
carries the best score and the piece count of each prefix. Ties follow the public unigram tokenizer: a later
candidate replaces an earlier one only with a strictly higher score, candidates come in order of their start,
an unknown character is a candidate only where no piece covers it alone, costs 10 less than the lowest score,
and neighbouring unknown characters are one piece.

The default vocabulary is that of a public BPE file: no unigram model is at hand, and that file's scores are the negated
ranks of its merges. They serve as unigram scores here, so counts are those of the unigram method over this
vocabulary, not those of the file's own BPE. Its byte pieces are left out: unknown characters count as unknown.

Texts are cut at blanks, which pieces never cross, and each task remembers the counts of words it has seen, none above
LONGEST code points. Batches hold 500 texts.

Edge cases: a null or empty text has 0 pieces; a leading blank is not doubled; other white space is part of a
word; words of any length are searched whole, PART code points at a
time; an empty table gives an empty result; duplicate rows give duplicate results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, scratch, table

BLANK = "▁"
#: Fixed value: what an unknown character costs beside the lowest score.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, and the longest of them.
REMEMBERED, LONGEST = 250_000, 100
#: Code points of a word that are searched at a time.
PART = 1 << 14


def public_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, without its control and byte pieces."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def word_counter(pieces: list[tuple[str, float]]) -> Callable[[str], int]:
    import ahocorasick

    # With equal pieces the last one counts, as in the public tokenizer.
    scores = dict(pieces)
    automaton = ahocorasick.Automaton()
    for piece, score in scores.items():
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(scores.values()) - UNKNOWN_PENALTY

    reach = max(map(len, scores))

    def count(word: str) -> int:
        # The state of every prefix of the part and of as many before it as a piece can reach back.
        best, pieces_to, open_unknown = [0.0], [0], [False]
        for low in range(0, len(word), PART):
            part = word[max(0, low - reach) : low + PART]
            skip, n = min(low, reach), min(PART, len(word) - low)
            ending: list[list[tuple[int, float]]] = [[] for _ in range(skip + n)]
            for end, match in automaton.iter(part):
                ending[end].append(match)
            for end in range(skip, skip + n):
                top, here, open_here, alone = None, 0, False, False
                # Longest first, so starts ascend.
                for length, score in sorted(ending[end], reverse=True):
                    start = end + 1 - length
                    value = score + best[start]
                    if top is None or value > top:
                        top, here = value, pieces_to[start] + 1
                    alone = alone or length == 1
                if not alone and (top is None or unknown + best[end] > top):
                    top, here, open_here = unknown + best[end], pieces_to[end] + (not open_unknown[end]), True
                best.append(top)
                pieces_to.append(here)
                open_unknown.append(open_here)
            if low + PART < len(word):
                best, pieces_to, open_unknown = (x[-reach - 1 :] for x in (best, pieces_to, open_unknown))
        return pieces_to[-1]

    return count


class _Counts(dict):
    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(BLANK + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def text_counter(pieces: list[tuple[str, float]]) -> Callable[[str | None], int]:
    counts = _Counts(word_counter(pieces))

    def count(text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(BLANK, " ").split(" ")
        return sum(map(counts.__getitem__, words[1:] if not words[0] else words))

    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(public_pieces(vocabulary))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with batches_of(spark, 500):
        return scratch(token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id"), "token-counts")


QUERIES = {"op3_token_counts": op3_token_counts}
