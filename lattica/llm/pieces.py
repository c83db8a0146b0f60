"""SentencePiece encoding and decoding (operator 9) for merge-type vocabularies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import rows_of, slices, tidy

SPACE = "▁"
#: Segments remembered in each of two generations.
REMEMBERED = 120_000
#: Characters that a segment may begin with, if the vocabulary allows it.
MARKS = ".,;:!?()[]{}\"'|#*$%&<>/+=-\n\t"
TEXT_BYTES = 1 << 20


def production_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Encodes texts with a merge-type SentencePiece model.

    A text becomes a marked blank and its characters, with blanks marked. Adjacent symbols are merged best score
    first, the leftmost of equals, from an agenda of pairs. A merge gives a piece, so none crosses a place between two
    characters that no piece has next to each other. Texts are cut at such places, before marked blanks and before
    those of MARKS that follow no letter or digit in any piece; segments are encoded alone and remembered. Each is
    compared with the sentencepiece library when it is first encoded, a batch at a time.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size())]
        self.ids = {p: i for i, p in kinds if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        named = {p: i for i, p in kinds if lib.is_byte(i)}
        self.bytes = [named.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.decimals = [str(i) for i in range(lib.get_piece_size())]
        self.pattern = re.compile(self._segment())
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.lead = tuple(self.merge(f"{SPACE}a"))

    def _segment(self) -> str:
        """A pattern of segments."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            return "(?s).+"
        marks = {m for m in MARKS if not any(b == m and (a.isalpha() or a.isdecimal()) for a, b in pairs)}
        if not marks:
            return f"{SPACE}+[^{SPACE}]*"
        m = re.escape("".join(sorted(marks)))
        before = re.escape("".join(sorted({a for a, b in pairs if b in marks and a not in marks and a != SPACE})))
        more = f"(?:(?<=[{before}])[{m}]+[^{SPACE}{m}]*)*" if before else ""  # no cut after these
        return f"{SPACE}+[{m}]*[^{SPACE}{m}]*{more}|[{m}]+[^{SPACE}{m}]*{more}"

    def merge(self, segment: str) -> list[int]:
        """The ids of one segment."""
        return self._ids(self._merge_short(segment) if len(segment) <= 24 else self._merge_long(segment))

    def _merge_short(self, segment: str) -> list[str]:
        """With the agenda as a list of the scores of all pairs: for a few symbols faster than a heap."""
        symbols, score, none = list(segment), self.scores.get, -float("inf")
        agenda = [score(segment[i : i + 2], none) for i in range(len(segment) - 1)]
        while agenda and (top := max(agenda)) > none:
            i = agenda.index(top)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """With the agenda as a heap."""
        symbols, scores = list(segment), self.scores
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := segment[i : i + 2]) in scores]
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = follower = after[right]
            after[right] = -2
            if follower >= 0:
                before[follower] = left
                if (p := piece + symbols[follower]) in scores:
                    heappush(agenda, (-scores[p], left, follower, p))
            if (leader := before[left]) >= 0 and (p := symbols[leader] + piece) in scores:
                heappush(agenda, (-scores[p], leader, left, p))
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [i] if i is not None else [self.unknown] if self.bytes[0] is None else [self.bytes[b] for b in s.encode()]
        return out

    def learn(self, segments: set[str]) -> None:
        """Encode new segments and compare them with the library."""
        if len(self.young) + len(segments) > REMEMBERED:
            self.old, self.young = self.young, {}
        new = []
        for s in segments:
            if s in self.young:
                continue
            if s in self.old:
                self.young[s] = self.old[s]
            else:
                self.young[s] = tuple(self.merge(s))
                new.append(s)
        # the library puts a marked blank before a text, and gives nothing for an empty one
        checked = [s for s in new if s != SPACE]
        texts = [s[1:] if s[0] == SPACE else f"a{s}" for s in checked]
        for s, ids in zip(checked, self.library.encode([t.replace(SPACE, " ") for t in texts], num_threads=1), strict=True):
            if tuple(ids) != (self.young[s] if s[0] == SPACE else self.lead + self.young[s]):
                raise RuntimeError(f"{s!r} is encoded otherwise by the library: {ids} and {self.young[s]}")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text. A text alone is taken in runs of segments, so that only its ids are held as a whole."""
        if len(texts) == 1 and texts[0]:
            found = map(re.Match.group, self.pattern.finditer(SPACE + texts[0].replace(" ", SPACE)))
            ids: list[int] = []
            while some := list(islice(found, REMEMBERED // 2)):
                self.learn(set(some))
                ids += chain.from_iterable(map(self.young.__getitem__, some))
            return [ids]
        cut = [self.pattern.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        known = self.young.__getitem__
        return [list(chain.from_iterable(map(known, c))) for c in cut]


def _texts(part: pa.RecordBatch) -> list[str | None]:
    return part.column("text").cast(pa.string()).to_pylist()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of each row's whole text, without begin or end ids; null and empty texts have none.

    Each row is encoded by itself: repeated rows and null ids give rows like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for part in slices(batches, most=TEXT_BYTES):
            ids = pieces.encode(_texts(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids, by the library; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Pieces(model).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([library.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, n_tokens, and digests of the decimal ids and of the decoded text.

    A null text counts as empty; repeated rows and null ids give rows like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for part in slices(batches, most=TEXT_BYTES):
            counts, ids_sha, text_sha = [], [], []
            for ids in pieces.encode(_texts(part)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(pieces.decimals.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(pieces.library.decode(ids).encode() if ids else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_model())
