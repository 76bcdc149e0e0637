"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates every vocabulary match; dynamic programming carries the best score and the number of pieces, no
back-pointers. Ties as in the public unigram tokenizers: of equal scores the match that starts first stays, and the unknown
character, which comes last, must be strictly better. A character without a piece of its own costs the least score less 10
and falls back to its UTF-8 bytes. Scores are added as doubles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ferrule.llm._shared import map_batches, shipped, worker_cache

shipped(__name__)

UNK_PENALTY = 10.0
SPACE = "▁"
#: Segments that a worker keeps, and the longest of them.
CACHE_SIZE, CACHE_CHARS = 500_000, 200


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces and their scores, from a sentencepiece model file of any kind."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.found.add_word(p, (len(p), score))
        self.found.make_automaton()
        self.unk, self.longest, self.single = min(pieces.values()) - UNK_PENALTY, max(map(len, pieces)), {p for p in pieces if len(p) == 1}
        crossed = any(SPACE in p.lstrip(SPACE) for p in pieces)  # by a piece: a space after something else
        lines = any("\n" in p and len(p) > 1 for p in pieces)
        self.split = re.compile(r" *[^ \n]+|\n| +" if not lines else r" *[^ ]+| +").findall if not crossed else lambda text: [text]
        self.known: dict[str, int] = {}

    def count_segment(self, segment: str) -> tuple[float, int]:
        """Best score and its number of pieces. Keeps only as many positions as the longest piece has characters."""
        n, keep = len(segment), self.longest + 1
        best, count = [0.0] * keep, [0] * keep
        matches = self.found.iter(segment) if n else iter(())
        ahead = next(matches, None)
        for end in range(n):
            top = None
            while ahead is not None and ahead[0] == end:  # longest, so earliest, first
                size, score = ahead[1]
                at = (end + 1 - size) % keep
                if top is None or best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
                ahead = next(matches, None)
            if segment[end] not in self.single and (top is None or best[end % keep] + self.unk > top):
                top, pieces = best[end % keep] + self.unk, count[end % keep] + len(segment[end].encode())
            best[(end + 1) % keep], count[(end + 1) % keep] = top, pieces
        return best[n % keep], count[n % keep]

    def count(self, text: str) -> int:
        """The number of ids of a text: spaces become the space mark, one more goes in front."""
        if not text:
            return 0
        segments, known = self.split(" " + text.replace(SPACE, " ")), self.known
        try:
            return sum([known[s] for s in segments])
        except KeyError:
            pass
        if len(known) > CACHE_SIZE:
            known.clear()
        own = {}
        for s in set(segments):
            if s in known:
                own[s] = known[s]
            else:
                own[s] = self.count_segment(s.replace(" ", SPACE))[1]
                if len(s) <= CACHE_CHARS:
                    known[s] = own[s]
        return sum([own[s] for s in segments])


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and n_tokens, the number of ids of the whole text under the vocabulary at path.

    Null and empty texts have 0. A null id stays null; repeated rows give repeated rows; an empty table an empty one. Other
    columns are not read, so their names cannot clash.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = worker_cache()
        if (key := ("unigram", path)) not in kept:
            kept[key] = UnigramCounter(load_pieces(path))
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kept[key].count(texts[i].as_py()) for i in range(len(texts))], pa.int64())], names=["id", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    return map_batches(df, [id_col, text_col], f"id {kind}, n_tokens long", run).withColumnRenamed("id", id_col)
