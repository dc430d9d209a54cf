"""Sequential text operators: chunkers, reflow, fuzzy de-duplication; a text at a time, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import rules as R
from quire.functions import text as T
from quire.operators.rows import rewritten, sliced
from quire.sources.runs import scratch_table

MAX_CHARS = 2400
BOUNDARY = re.compile(r"\n\n|[.!?][\"'”’)]?(?=\s|$)")
#: The same for chunks that keep speeches whole, and what ends a window as a sentence.
SENTENCE_END = re.compile(r"\n\n|[.!?]['\"”]?(?=\s|$)")
EDGE = re.compile(r"[.!?]['\"”]?\Z")
SPEECH_STARTS = ('"', "'", "-", "—", "“", "”")
CLOSED_ENDS = (".", "?", "!", '"', "'", ":", "”")
SHORT = 25
FOLD = 64
CHUNKS = "doc_id bigint, chunk_idx bigint, start_offset bigint, end_offset bigint, text string"


def joined_paragraphs(text: str) -> str:
    return "\n\n".join(p for p in (x.strip() for x in text.split("\n\n")) if p)


def strict_spans(text: str, most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Spans that end behind sentences or paragraphs, ``most`` long if they can be, longer if they must."""
    starts, ends = [], []
    for m in BOUNDARY.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    out, at = [], 0
    while at < len(text):
        limit = at + most
        if limit >= len(text):
            end = len(text)
        else:
            i = bisect_right(ends, limit) - 1
            end = ends[i] if i >= 0 and ends[i] > at else at
            if text[limit - 1] in ".!?":  # the edge of the window ends a sentence
                end = limit
            if end == at:
                j = bisect_right(starts, limit - 1)
                end = ends[j] if j < len(ends) else len(text)
        out.append((at, end))
        at = end
    return out


def _rows(make: Callable[[str], list[tuple[int, int, str]]]):
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ("text",)):
            rows = [(d, i, *c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(make(t or ""))]
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    return chunked


def strict_rows(text: str, most: int = MAX_CHARS) -> list[tuple[int, int, str]]:
    """(start, end, text) of the strict chunks of a text's joined paragraphs."""
    whole = joined_paragraphs(text)
    return [(a, b, whole[a:b]) for a, b in strict_spans(whole, most)]


def chunk_strict(docs: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """CHUNKS of each document's joined paragraphs; the chunks of a document, joined, are those."""
    return docs.select("doc_id", "text").mapInArrow(_rows(lambda text: strict_rows(text, most)), CHUNKS)


class Speeches:
    """A text's boundaries, and at each place how many curly quotes are open."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.end() for m in SENTENCE_END.finditer(text)]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.depth = np.concatenate([[0], np.cumsum((codes == ord("“")).astype(np.int64) - (codes == ord("”")))])

    def between(self, start: int, stop: int) -> list[int]:
        """The boundaries behind ``start`` up to ``stop``; the edge ends a sentence that stops there."""
        found = self.ends[bisect_right(self.ends, start) : bisect_right(self.ends, stop)]
        edge = EDGE.search(self.text, max(start, stop - 2), stop)
        return [*found, stop] if edge and stop not in found[-1:] else found

    def best(self, start: int, target: int, stop: int, depth: int) -> int | None:
        """The first boundary of this depth from ``target`` on, or else the last before it."""
        ends = [e for e in self.between(start, stop) if self.depth[e] == depth]
        i = bisect_left(ends, target)
        return ends[i] if i < len(ends) else ends[-1] if ends else None

    def end(self, start: int, most: int, ahead: int = 400, further: int = 1200) -> int:
        """Where the chunk from ``start`` ends: behind a sentence near ``most``, and where no speech is cut if that can be."""
        target, n = start + most, len(self.text)
        if target >= n:
            return n
        near, stop = self.between(start, min(n, target + ahead)), min(n, target + further)
        usual = near[-1] if near else target
        if self.depth[start] and (neutral := self.best(start, target, stop, 0)) is not None:
            return neutral
        if self.depth[usual] == self.depth[start]:
            return usual
        balanced = self.best(start, target, stop, int(self.depth[start]))
        return usual if balanced is None else balanced


def quote_spans(text: str, most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Spans of about ``most`` characters that end behind sentences and do not cut speeches."""
    s, out, at = Speeches(text), [], 0
    while at < len(text):
        end = s.end(at, most)
        out.append((at, end if end > at else min(at + most, len(text))))
        at = out[-1][1]
    return out


def quote_rows(text: str, most: int = MAX_CHARS) -> list[tuple[int, int, str]]:
    """(start, end, text) of chunks that keep speeches whole, without white space at their ends."""
    whole = joined_paragraphs(text)
    rows = []
    for a, b in quote_spans(whole, most):
        left, right = len(whole[a:b]) - len(whole[a:b].lstrip()), len(whole[a:b].rstrip())
        rows.append((a + left, max(a + right, a + left), whole[a:b].strip()))
    return rows


def chunk_quotes(docs: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """CHUNKS that keep speeches whole, without white space at their ends; offsets are those of what is left."""
    return docs.select("doc_id", "text").mapInArrow(_rows(lambda text: quote_rows(text, most)), CHUNKS)


def merge_stubs(chunks: DataFrame) -> DataFrame:
    """CHUNKS in which a blank chunk or a section's marker alone is put before the chunk after it; a last one is dropped.

    A document of stubs alone keeps the last.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_idx")
    rows = chunks.withColumn("stub", T.is_stub(F.col("text")))
    rows = rows.withColumn("group", F.count(F.when(~F.col("stub"), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col("text"), "start_offset", "end_offset", "stub")))
    whole = rows.groupBy("doc_id", "group").agg(parts.alias("p")).withColumn("alone", F.count("*").over(Window.partitionBy("doc_id")) == 1)
    last = F.try_element_at("p", F.lit(-1))
    whole = whole.filter(~last["stub"] | F.col("alone"))
    text = T.strip(F.array_join(F.transform("p", lambda x: T.strip(x["text"])), "\n\n"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("group")) - 1).cast("bigint")
    return whole.select("doc_id", number.alias("chunk_idx"), F.get("p", F.lit(0))["start_offset"].alias("start_offset"), last["end_offset"].alias("end_offset"), text.alias("text"))


def is_title(line: str) -> bool:
    """Whether a line reads as a title: cried, or short and with at most one small word, without an end mark."""
    s = line.strip()
    if s.isupper():
        return True
    words = [w for w in re.findall(r"[^\s-]+", s) if any(map(str.isalpha, w))]
    small = sum(not w[0].isupper() for w in words)
    return bool(words) and len(s) <= SHORT and not re.search("[.?!,;:]$", s) and small <= (len(words) > 2)


def joins(current: str, following: str) -> bool:
    """Whether a line goes on in the one after it."""
    after = following.lstrip()
    small = bool(after) and after[0].isalpha() and after[0].islower()
    return small and not current.rstrip().endswith(CLOSED_ENDS) and not is_title(current) and not is_title(after)


def reflow_text(text: str) -> tuple[str, int]:
    """Wrapped lines joined, blank lines made one; speech, titles and ended sentences stay."""
    out: list[str] = []
    count = gap = 0
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip():
            gap += 1
        elif out and joins(out[-1], line):
            last = out[-1].rstrip()
            out[-1] = (last[:-1] if last.endswith("-") else last + " ") + line.strip()
            count, gap = count + 1, 0
        else:
            if gap and out:
                out.append("")
            out.append(line.strip())
            gap = 0
    return "\n".join(out).strip(), count


def safe_reflow(docs: DataFrame) -> DataFrame:
    return rewritten(docs.select("doc_id", "text"), reflow_text, ["joins"])


#: Characters of a text after which it is asked whether enough of them can still stand in common order.
LOOK = 128


def in_common_order(a: str, b: str, least: int = 0) -> int:
    """The length of the longest common subsequence, by one row of bits a character of ``b``; if it is below ``least``, some length below that.

    What the texts begin and end with in common is in one such sequence, so only the rest is looked at.
    """
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    found, spare = begin + end + len(a), begin + end + len(b) - least  # characters of b that may be without a partner
    for at in range(0, len(b), LOOK):
        for c in b[at : at + LOOK]:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & whole
        done = min(at + LOOK, len(b))
        if done - (len(a) - row.bit_count()) > spare:
            return min(found - row.bit_count(), least - 1)
    return found - row.bit_count()


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether the sequence matcher's ratio can reach ``least``, whichever text comes first.

    What it matches stands in common order in both texts, so lengths and the longest common subsequence bound it, and
    nearly all pairs below ``least`` are decided without it.
    """
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * both:
        return False
    return a == b or 2.0 * in_common_order(a, b, int(least * both / 2)) / both >= least


def ratio_at_least(a: str, b: str, least: float) -> bool:
    """Whether the sequence matcher's ratio reaches ``least``."""
    return may_reach(a, b, least) and SequenceMatcher(None, a, b).ratio() >= least


def alike(least: float) -> Callable[[str, str], bool]:
    """Equal, one within the other and three quarters as long, or of a ratio of ``least``."""

    def test(a: str, b: str) -> bool:
        short, long = sorted((a, b), key=len)
        return bool(short) and (a == b or 4 * len(short) >= 3 * len(long) and short in long or ratio_at_least(a, b, least))

    return test


def dedupe_text(text: str) -> tuple[str, dict[str, int]]:
    """Lines, then paragraphs, that nearly repeat the one before go; the wider of the two stays."""
    lines, n = prose.without_repeats(prose.split_lines(text), alike(0.94), True)
    parts, m = prose.without_repeats("\n".join(lines).split("\n\n"), alike(0.9), False)
    return "\n\n".join(parts), {"lines_removed": n, "blocks_removed": m}


def dedupe_adjacent(docs: DataFrame) -> DataFrame:
    return rewritten(docs.select("doc_id", "text"), dedupe_text, ["lines_removed", "blocks_removed"])


def has_repeats(text: str, least: float = 0.96) -> bool:
    """Whether a line nearly repeats the filled line before it."""
    forms = [f for f in map(prose.folded, prose.split_lines(text)) if f]
    near = lambda a, b: abs(len(a) - len(b)) <= max(8, max(len(a), len(b)) // 5) and ratio_at_least(a, b, least)
    return any(a == b or near(a, b) for a, b in pairwise(forms))


def glued(c: Column) -> Column:
    """struct(text, breaks): a line break between speeches that stand in one line; headings stay."""
    first, second = R.GLUED
    heading = lambda x: F.ltrim(x).startswith("#")
    once = lambda x: F.regexp_replace(x, first, "$1\n")
    line = lambda x: F.when(heading(x), F.struct(x.alias("x"), F.lit(0).alias("n"))).otherwise(F.struct(F.regexp_replace(once(x), second, "$1\n").alias("x"), (F.regexp_count(x, F.lit(first)) + F.regexp_count(once(x), F.lit(second))).alias("n")))
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, r: s + r["n"])
    whole = lambda rows: F.struct(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("text"), total(rows).alias("breaks"))
    return T.let(F.transform(T.lines(F.coalesce(c, F.lit(""))), line), whole)


def fix_glued(docs: DataFrame) -> DataFrame:
    """(doc_id, text, breaks)."""
    return docs.select("doc_id", glued(docs["text"]).alias("g")).select("doc_id", "g.text", "g.breaks")


#: Texts of one document that are compared with each other in one group, two such blocks at most; buckets of q-grams.
BLOCK, GRAM, BUCKETS = 256, 3, 256


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a text's letters and of its q-grams, both folded: what differs there differs at least as much unfolded."""
    for batch in sliced(batches, ("norm",)):
        out = []
        for text in batch["norm"].to_pylist():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            n = max(0, len(codes) - GRAM + 1)
            grams = sum((codes[i : i + n] * np.uint64(prime) for i, prime in enumerate((1, 1_000_003, 998_244_353))), np.zeros(n, np.uint64))
            counts = np.concatenate([np.bincount(codes % np.uint64(FOLD), minlength=FOLD), np.bincount((grams >> np.uint64(7)) % np.uint64(BUCKETS), minlength=BUCKETS)])
            out.append(np.minimum(counts, 65535).astype("<u2").tobytes())
        yield pa.record_batch([*[batch[c] for c in ("doc_id", "at", "size", "block")], pa.array(out, pa.binary())], names=["doc_id", "at", "size", "block", "counts"])


def _candidates(least: float):
    """Pairs of two blocks whose counts allow the ratio.

    A ratio of ``least`` means m characters in common order, m >= least (a + b) / 2.  What is not common changes as many
    letters, and at most GRAM q-grams each in its own text and GRAM - 1 in the other.
    """

    def compare(group: pa.Table) -> pa.Table:
        size = group["size"].to_numpy()
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), "<u2").reshape(len(size), FOLD + BUCKETS).astype(np.int32)
        at, side = group["at"].to_numpy(), group["side"].to_numpy()
        rows, others = np.flatnonzero(side == 0), np.flatnonzero(side == group["last"][0].as_py())
        out = []
        for i in rows:
            j = others if side[i] != group["last"][0].as_py() else others[others > i]
            a, b = size[i], size[j]
            m = np.ceil(least * (a + b) / 2 - 1e-9)
            j, b, m = j[m <= np.minimum(a, b)], b[m <= np.minimum(a, b)], m[m <= np.minimum(a, b)]
            kept = np.maximum(b - GRAM + 1 - GRAM * (b - m) - (GRAM - 1) * (a - m), a - GRAM + 1 - GRAM * (a - m) - (GRAM - 1) * (b - m))
            grams = np.maximum(a - GRAM + 1, 0) + np.maximum(b - GRAM + 1, 0)
            differ = np.abs(counts[j] - counts[i])
            fits = (differ[:, :FOLD].sum(1) <= a + b - 2 * m) & (differ[:, FOLD:].sum(1) <= grams - 2 * np.maximum(kept, 0))
            out += [(at[i], at[k]) for k in j[fits]]
        doc = group["doc_id"][0].as_py()
        return pa.table([pa.array([doc] * len(out), pa.int64()), pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.int32())], names=["doc_id", "x", "y"])

    return compare


def _verified(least: float):
    """The matcher's ratio is not the same both ways, so both are told."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ("tx", "ty")):
            texts = list(zip(batch["tx"].to_pylist(), batch["ty"].to_pylist(), strict=True))
            may = [may_reach(x, y, least) for x, y in texts]
            ways = [[ok and SequenceMatcher(None, *pair[::way]).ratio() >= least for ok, pair in zip(may, texts, strict=True)] for way in (1, -1)]
            yield pa.record_batch([batch["doc_id"], batch["x"], batch["y"], *[pa.array(w, pa.bool_()) for w in ways]], names=["doc_id", "x", "y", "xy", "yx"])

    return verify


def near_duplicate_pairs(chunks: DataFrame, least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(doc_id, a, b): chunks of one document so alike that one's result may serve the other, ``a`` the earlier.

    Equal texts are compared once.  A document's distinct texts, in order of length, are dealt out in blocks; two blocks
    whose lengths allow the ratio meet in a group, with counts of letters and q-grams instead of texts, and only pairs
    whose counts allow the ratio are compared as texts.  So no task holds a document, and every pair that has the ratio
    is found.  Rows without doc_id or text have no pairs.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("doc_id is not null and text is not null").select("doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), T.squeeze(F.col("text")).alias("norm"))
    rows = scratch_table(spark, rows, "normal-chunks")
    distinct = rows.groupBy("doc_id", "norm").agg(F.min("chunk_idx").alias("at"), F.count("*").alias("copies"))
    distinct = scratch_table(spark, distinct.withColumn("size", F.length("norm").cast("bigint")), "distinct-chunks")
    several = distinct.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("size", "at")
    ranks = distinct.join(several, "doc_id").select("doc_id", "at", "size", F.floor((F.row_number().over(order) - 1) / block).alias("block"))
    texts = ranks.join(distinct.select("doc_id", "at", "norm"), ["doc_id", "at"]).select("doc_id", "at", "size", "block", "norm")
    counted = scratch_table(spark, texts.mapInArrow(_features, "doc_id bigint, at int, size bigint, block bigint, counts binary"), "counts")
    spans = counted.groupBy("doc_id", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    left, right = (spans.select("doc_id", F.col("block").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in ("i", "j"))
    meet = left.join(right, "doc_id").filter((F.col("i") <= F.col("j")) & (F.col("low_j") <= F.col("high_i") * ((2 - least) / least) + 1)).select("doc_id", "i", "j")
    last = F.when(F.col("i") < F.col("j"), 1).otherwise(0).alias("last")
    one = counted.join(meet.withColumn("block", F.col("i")), ["doc_id", "block"]).select("doc_id", "i", "j", "at", "size", "counts", F.lit(0).alias("side"), last)
    two = counted.join(meet.filter("i < j").withColumn("block", F.col("j")), ["doc_id", "block"]).select("doc_id", "i", "j", "at", "size", "counts", F.lit(1).alias("side"), last)
    found = one.union(two).groupBy("doc_id", "i", "j").applyInArrow(_candidates(least), "doc_id bigint, x int, y int")
    named = lambda n: distinct.select("doc_id", F.col("at").alias(n), F.col("norm").alias(f"t{n}"))
    tried = scratch_table(spark, found, "candidates").join(named("x"), ["doc_id", "x"]).join(named("y"), ["doc_id", "y"]).select("doc_id", "x", "y", "tx", "ty")
    near = scratch_table(spark, tried.mapInArrow(_verified(least), "doc_id bigint, x int, y int, xy boolean, yx boolean").filter("xy or yx"), "near-texts")
    members = rows.join(distinct.select("doc_id", "norm", "at", "copies"), ["doc_id", "norm"]).select("doc_id", "at", "copies", "chunk_idx")
    side = lambda n, c: members.select("doc_id", F.col("at").alias(n), F.col("chunk_idx").alias(c))
    across = near.join(side("x", "cx"), ["doc_id", "x"]).join(side("y", "cy"), ["doc_id", "y"])
    across = across.filter(((F.col("cx") < F.col("cy")) & F.col("xy")) | ((F.col("cy") < F.col("cx")) & F.col("yx"))).select("doc_id", F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"))
    # the matcher passes over frequent letters in long texts, so even a copy may lack the ratio
    copies = distinct.filter("copies > 1").select("doc_id", F.col("at").alias("x"), F.col("at").alias("y"), F.col("norm").alias("tx"), F.col("norm").alias("ty"))
    alike = copies.mapInArrow(_verified(least), "doc_id bigint, x int, y int, xy boolean, yx boolean").filter("xy").select("doc_id", F.col("x").alias("at"))
    again = scratch_table(spark, members.filter("copies > 1").join(alike, ["doc_id", "at"]), "copies")
    same = again.select("doc_id", "at", F.col("chunk_idx").alias("a")).join(again.select("doc_id", "at", F.col("chunk_idx").alias("b")), ["doc_id", "at"]).filter("a < b").select("doc_id", "a", "b")
    return across.union(same).distinct()
