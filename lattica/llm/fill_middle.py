"""Fill-in-middle transformation (operator 11): texts cut into units, dealt to prefix, middle and suffix, and put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import rows_of, slices, tidy

#: A run of ASCII letters, or one code point of any other kind, over UTF-8 bytes.
UNIT = r"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*"
#: A byte that no UTF-8 text holds; it ends each unit when a text is split.
END = b"\xff"
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a text from which it is split in segments, and bytes of segments split at once.
SEGMENT, AT_ONCE = 1 << 20, 2 << 20
#: Of 100 texts, those from here on stay plain; of 100 others, those below go suffix first.
PLAIN, SPM = 90, 20


def segments(text: bytes, size: int = SEGMENT) -> list[bytes]:
    """The text in segments of about so many bytes that begin with a unit; a longer run of letters is not cut."""
    if len(text) <= size:
        return [text]
    data = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text):
            own = data[end : end + size]
            starts = ((own < 0x80) | (own >= 0xC0)) & ~(((own | 0x20) >= 97) & ((own | 0x20) <= 122) & (own < 0x80))
            if starts.any():
                end += int(np.argmax(starts))
                break
            end += size
        out.append(text[at:end])
        at = end
    return out


def _grouped(values: pa.Array, owners: np.ndarray, n: int) -> pa.Array:
    """values, ordered by owner, as one list for each of n owners."""
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owners, minlength=n), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _roles(parts: pa.Array, base: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Of segments whose first units have the ordinals base: the bytes of their units below low, up to high, and from high on."""
    units = pc.split_pattern(pc.replace_substring_regex(parts, pattern=UNIT, replacement=b"\\0" + END), END)
    parent = pc.list_parent_indices(units).to_numpy()
    flat = pc.list_flatten(units)
    ordinal = np.arange(len(flat)) - (units.offsets.to_numpy()[:-1] - units.offsets[0].as_py())[parent] + base[parent]
    role = pa.array((ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent]))
    out = []
    for r in range(3):
        mine = pc.equal(role, r)
        out.append(pc.binary_join(_grouped(flat.filter(mine), parent[mine.to_numpy(zero_copy_only=False)], len(parts)), b""))
    return out


def _pieces(texts: pa.Array, cuts: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units of each text, and its prefix, middle and suffix; ``cuts`` are two digests of each text, taken modulo units + 1, or -1 for none."""
    long = [i for i, size in enumerate(pc.binary_length(texts).to_pylist()) if size > SEGMENT]
    if long:
        split = [segments(t.as_py()) if i in set(long) else [t.as_py()] for i, t in enumerate(texts)]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        parts = pa.array([x for s in split for x in s], pa.binary())
    else:
        owner, parts = np.arange(len(texts)), texts
    each = pc.count_substring_regex(parts, pattern=UNIT).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.bincount(owner, each, len(texts)).astype(np.int64)
    firsts = np.cumsum(each) - each
    base = firsts - firsts[np.searchsorted(owner, owner)] if len(owner) else firsts
    at = np.where(cuts < 0, 0, cuts % (n[:, None] + 1))
    low, high = at.min(axis=1), at.max(axis=1)
    found: list[list[pa.Array]] = [[], [], []]
    begin = 0
    for run in slices([pa.record_batch({"text": parts})], most=AT_ONCE):
        own = slice(begin, begin + run.num_rows)
        begin += run.num_rows
        for f, x in zip(found, _roles(run.column("text"), base[own], low[owner[own]], high[owner[own]]), strict=True):
            f.append(x)
    whole = [pa.concat_arrays(f) if f else pa.array([], pa.binary()) for f in found]
    return n, [pc.binary_join(_grouped(w, owner, len(texts)), b"") for w in whole] if long else whole


def digests_of(doc_ids: list[int | None]) -> np.ndarray:
    """The first four 32-bit numbers of the SHA-256 of ``1:`` and each id in decimal (nothing for null)."""
    raw = b"".join(hashlib.sha256(b"1:%b" % (b"" if i is None else b"%d" % i)).digest()[:16] for i in doc_ids)
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, 4)


def _transformed(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(part.column("text"), b"")
    h = digests_of(part.column("doc_id").to_pylist())
    marked = pc.match_substring(texts, MARKS[0])
    for m in MARKS[1:]:
        marked = pc.or_(marked, pc.match_substring(texts, m))
    plain = marked.to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= PLAIN) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    n, (prefix, middle, suffix) = _pieces(texts, np.where(plain[:, None], -1, h[:, :2]))
    p, s, m = (pa.scalar(x.encode()) for x in MARKS)
    joined = lambda *x: pc.binary_join_element_wise(*x, b"")
    spm = pa.array(h[:, 3] % 100 < SPM)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(spm, joined(s, suffix, p, prefix, m, middle), joined(p, prefix, s, suffix, m, middle)))
    chars = lambda x: pc.if_else(pa.array(plain), None, pc.utf8_length(x.view(pa.string())).cast(pa.int64()))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), form, chars(prefix), chars(middle), output.view(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row's whole text.

    Units are runs of ASCII letters and single other code points. Two places between units, drawn by the id's digest,
    part the text in prefix, middle and suffix. Form ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm``
    ``<S>suffix<P>prefix<M>middle``, ``plain`` the text as it is: empty texts, texts that hold a mark, and a tenth of
    the others. The work is a pipeline of Arrow kernels on each batch: units become list arrays, are flattened
    with the index of their text, numbered, filtered by role, put back in lists, and joined. No row needs another one,
    so nothing is shuffled. Texts of over 1 MB are split in segments, of which 2 MB are in units at once.

    A null text counts as empty. A null id has the digest of ``1:``. Repeated rows and ids give rows like any other;
    other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _transformed(part)

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, in columns: each mark is there once, since texts that hold one are plain."""
    p, s, m = MARKS
    last = F.substring_index(output, m, -1)
    rest = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, s, 1), p, -1), last, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), last, F.substring_index(F.substring_index(rest, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Units, form, sizes and digests of the output, and of the text restored from it, for every document."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS z, ('0x' || h[25:32])::BIGINT % 100 AS w FROM u),
f AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
