"""Token counts under a unigram vocabulary, by a Viterbi that counts and builds no pieces.

Text is cut before every blank, each part beginning with the mark that stands for a blank (a text
not beginning with a blank gets one). An Aho-Corasick automaton enumerates the vocabulary's matches
by their end; for every end the dynamic programme keeps the best score, the number of pieces of
the best path and whether it ends with an unknown character. The rules are those of the usual
unigram encoder: scores are added in double precision from the left, the first of equal candidates
by start wins, a character that is no piece itself is unknown at the least score minus 10, and
neighbouring unknown characters are one piece. Parts do not interact, so counts of parts are kept
in a table of bounded size within a task. The scan is narrow.

No unigram vocabulary comes with the box. ``vocabulary`` takes the pieces of a BPE model file and
scores them by Zipf's law on their rank; any list of (piece, score) works.

Nulls and empty texts have no tokens; equal rows have equal counts; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsmood.llm.words import broadcast, pick, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0  # below the least score
MOST_PIECES = 1_000_000
CACHE = 200_000
CACHED_LENGTH = 64


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentence-piece model file with Zipf scores, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / k for k in range(1, len(pieces) + 1))
    return [(p, -math.log(k * total)) for k, p in enumerate(pieces, 1)]


class Counter:
    """Piece counts of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.known: dict[str, tuple[int, int]] = {}

    def _part(self, part: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of the best path over one part."""
        n = len(part)
        score, count, lost = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1)
        dark = [False] * (n + 1)
        end = 0

        def close(e):
            """The unknown character that ends at e comes last among the candidates."""
            if part[e - 1] not in self.single and score[e - 1] + self.unknown > score[e]:
                more = not dark[e - 1]
                score[e] = score[e - 1] + self.unknown
                count[e], lost[e], dark[e] = count[e - 1] + more, lost[e - 1] + more, True

        for at, (size, value) in self.automaton.iter(part):  # longest first at each end
            while end < at:
                end += 1
                close(end)
            a, e = at + 1 - size, at + 1
            if score[a] + value > score[e]:
                score[e] = score[a] + value
                count[e], lost[e], dark[e] = count[a] + 1, lost[a], False
        while end < n:
            end += 1
            close(end)
        return count[n], lost[n]

    def of(self, text: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of a text."""
        if not text:
            return 0, 0
        parts = text.replace(MARK, " ").split(" ")  # the mark itself reads as a blank
        if parts[0] == "":  # the text begins with a blank, which is the first part's mark
            parts = parts[1:]
        known, total, unknown = self.known, 0, 0
        for part in parts:
            found = known.get(part)
            if found is None:
                found = self._part(MARK + part)
                if len(part) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[part] = found
            total += found[0]
            unknown += found[1]
        return total, unknown


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_tokens, n_unknown`` (pieces that are unknown)."""
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces are not broadcast")
    rows = pick(docs, doc_id, text)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("n_tokens long, n_unknown long")])
    shared = broadcast(docs.sparkSession, pieces)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, counter = to_arrow_schema(schema), Counter(shared())
        for batch in batches:
            for part in slices(batch, batch.schema.field(1).name):
                counts = [counter.of(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(arrow.field(0).type), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)
