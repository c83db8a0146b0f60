"""Spelling variant grouping (operator 12): words one edit apart, by composing acceptors of the vocabulary with a one-edit transducer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SENT_IDS, dealt, discard, groups, rows_of, slices, store, tidy

#: A-Z, a-z and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]+|(?:\xc3[\x80-\xbf])+)+")
GAP = re.compile(rb"[\x00-@\[-`{-\x7f]")
#: One of so many (document, word) pairs loses a code point.
DAMAGED = 97
#: Words of a partition composed in one task; larger ones are parted by a longer start.
GROUP = 4096
#: Bytes of a text searched for words at once, and of words counted before counts are sent on.
AT_ONCE, COUNTED = 4 << 20, 200_000


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks of about AT_ONCE bytes that part no word, if there is a place."""
    at = 0
    while len(text) - at > AT_ONCE:
        gap = GAP.search(text, at + AT_ONCE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words, n = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    for part in slices(batches):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            if not text:
                continue
            start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            for block in _blocks(text):
                for word, n in Counter(RUN.findall(block.lower())).items():
                    h = zlib.crc32(word, start)
                    if h % DAMAGED == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) >= least and (word.isascii() or len(word.decode()) >= least):
                        held[word] += n
                if len(held) >= COUNTED:
                    yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame, least_chars: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least so many code points and occurrences over all rows.

    A word whose CRC-32 after its document's id is divisible by 97 has lost one code point in that document. Words are
    counted by document, then by task, before the shuffle, so a word that a third of all texts hold sends a row a
    task. Null texts have no words; a null id counts as no digits; repeated rows count again.
    """
    found = rows_of(docs, id_col, text_col).mapInArrow(tidy(lambda b: _counts(b, least_chars)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words: states with the same right language are one.

    ``accepted`` walks its composition with a one-edit transducer and with itself. A composed state is two states of the
    automaton and the edits so far. Before the edit both sides have read the same, so the two are one state; the edit
    is a replaced or an inserted letter; after it both sides read the same letters again.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settled(node: list) -> int:
            key = (node[1], *node[0].items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(node[0])
                self.final.append(node[1])
            return state

        path: list[list] = [[{}, False]]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                state = settled(path.pop())
                path[-1][0][last[len(path) - 1]] = state
            for _ in range(same, len(word)):
                path.append([{}, False])
            path[-1][1] = True
            last = word
        while len(path) > 1:
            state = settled(path.pop())
            path[-1][0][last[len(path) - 1]] = state
        self.start = settled(path.pop())

    def common(self, a: int, b: int, but: str = "") -> Iterator[str]:
        """The words in the right languages of both states that do not begin with the letter ``but``."""
        read: list[str] = []
        stack = [(a, b, 0, "")]
        while stack:
            a, b, depth, letter = stack.pop()
            if depth:
                read[depth - 1 :] = [letter]
            if self.final[a] and self.final[b]:
                yield "".join(read[:depth])
            arcs, other = self.arcs[a], self.arcs[b]
            if len(arcs) > len(other):
                arcs, other = other, arcs
            for x in arcs:
                if x in other and (depth or x != but):
                    stack.append((self.arcs[a][x], self.arcs[b][x], depth + 1, x))

    def accepted(self) -> Iterator[tuple[str, str]]:
        """Each two words that differ by one inserted or replaced letter, once; of different lengths the shorter first.

        Of the places where an inserted letter may stand, the last one counts: there the two words first differ.
        """
        read: list[str] = []
        stack = [(self.start, 0, "")]
        while stack:
            state, depth, letter = stack.pop()
            if depth:
                read[depth - 1 :] = [letter]
            arcs = list(self.arcs[state].items())
            for i, (x, a) in enumerate(arcs):
                for y, b in arcs[i + 1 :]:
                    for rest in self.common(a, b):
                        before = "".join(read[:depth])
                        yield f"{before}{x}{rest}", f"{before}{y}{rest}"
                for rest in self.common(state, a, x):
                    before = "".join(read[:depth])
                    yield before + rest, f"{before}{x}{rest}"
                stack.append((a, depth + 1, x))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a partition that has near words in it: how many, and the most frequent, then smallest one."""
    out: list[list] = [[], [], [], []]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "near_n", "near"])
        for o in out:
            o.clear()
        return batch

    for group in groups(batches, "key", "m", "backward", "exact"):
        if group.num_rows < 2:
            continue
        m, backward, exact, depth = (group.column(c)[0].as_py() for c in ("m", "backward", "exact", "depth"))
        n = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True))
        half = (m + 1) // 2
        met: dict[str, list] = {}
        for a, b in Acceptor(sorted(w[::-1] if backward else w for w in n)).accepted():
            if min(len(a), len(b)) != m or a[:depth] != b[:depth] or (exact and a[depth : depth + 1] == b[depth : depth + 1]):
                continue
            if backward:
                a, b = a[::-1], b[::-1]
            if (a[:half] == b[:half]) == backward:
                continue
            for x, y in ((a, b), (b, a)):
                own = met.setdefault(x, [0, 0, ""])
                own[0] += 1
                if n[y] > own[1] or (n[y] == own[1] and y < own[2]):
                    own[1:] = n[y], y
        for word, (count, near_n, near) in met.items():
            for o, v in zip(out, (word, count, near_n, near), strict=True):
                o.append(v)
        if len(out[0]) >= 4096:
            yield flush()
    if out[0]:
        yield flush()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near) of the words (word, n) that have near ones: of the most frequent, the smallest.

    Near words differ by exactly one inserted, deleted or replaced code point. ``words`` is a stored table of distinct
    words. A pair whose shorter word has m code points either shares its first half, and the edit is after it, or it
    shares the last half and the edit is before it. So the composed machine is entered behind each shared half,
    forwards, or backwards over reversed words, and a partition holds the words that enter at one such state. A
    partition of more than ``group`` words is entered one letter later, once for each letter; the pairs that differ
    in that very letter meet by what follows it, one letter's alternatives in a partition. Each pair is met once, and a
    word sends one row for all its near words in a partition.
    """
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("backward")
    m = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("m")
    rows = words.select("word", "n", m).select("*", both)
    rows = rows.withColumn("depth", F.when(F.col("backward"), F.floor(F.col("m") / 2)).otherwise(F.ceil(F.col("m") / 2)).cast("int"))
    way = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    start = F.xxhash64("depth", F.substring(way, F.lit(1), F.col("depth")))
    level = rows.select("*", start.alias("key"))
    columns = ["key", "m", "backward", "exact", "depth", "word", "n"]
    ready = None
    while True:
        hot = store(level.groupBy("key", "m", "backward").agg(F.count("*").alias("members")).where(F.col("members") > group).drop("members"), "hot")
        if hot.isEmpty():
            part = level.withColumn("exact", F.lit(False)).select(columns)
            ready = part if ready is None else ready.unionByName(part)
            break
        told = F.broadcast(hot) if hot.count() <= SENT_IDS else hot
        few = level.join(told, ["key", "m", "backward"], "left_anti").withColumn("exact", F.lit(False)).select(columns)
        many = store(level.join(told, ["key", "m", "backward"], "left_semi"), "many")
        # with the letter at this place, and without it
        rest = lambda skipped: F.xxhash64("key", F.substring(way, F.col("depth") + 1 + skipped, F.char_length("word")))
        here = F.array(rest(0), F.when(F.char_length("word") > F.col("depth"), rest(1)))
        exact = many.select("m", "backward", F.lit(True).alias("exact"), "depth", "word", "n", F.explode(here).alias("key")).where("key IS NOT NULL").select(columns)
        ready = few.unionByName(exact) if ready is None else ready.unionByName(few).unionByName(exact)
        level = many.where(F.char_length("word") > F.col("depth")).withColumn("depth", F.col("depth") + 1).withColumn("key", start)
    found = dealt(ready, "key", "m", "backward", "exact").mapInArrow(tidy(_near), "word string, n_near long, near_n long, near string")
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("most")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), most).select("word", "n_near", (-F.col("most.less")).alias("near_n"), F.col("most.near").alias("near"))


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of distinct words (word, n).

    form is the most frequent near word, of equals the smallest, if it occurs at least ``times`` as often (2 or more, so
    that no chain comes back); root is the last word that forms lead to. Roots are found by doubling: a round lets each
    word follow the forms of the word that it has come to, so rounds grow with the logarithm of the longest
    chain. An empty table gives none.
    """
    words = store(words.select("word", "n"), "words")
    near = near_words(words)
    told = F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))
    known = store(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), told.alias("form"), F.when(told.isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    discard(words)
    to = store(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.toDF("root", "next")
        moved = store(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(to)
        to = moved.select("word", "root")
        to.stored_at = moved.stored_at
        if moved.where("moved").isEmpty():
            break
    return known.join(to, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling_groups(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
b AS (SELECT list(v ORDER BY i) AS crc FROM c WHERE k = 8),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
         lambda s, y: xor(s >> 8, crc[(xor(s, y) & 255) + 1]))) AS h FROM d, b),
v AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
e AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM v, unnest(range(1, length(word) + 1)) t(i)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.less = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.less = v.word),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN g ON v.word = g.word),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, t.next, f.form FROM t JOIN f ON t.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word AND t.next IS NULL
"""
