"""Benchmark decontamination: an FM-index for each shard of the training texts.

A shard is a run of rows of one partition, of bounded bytes, or a bounded piece of a very long text (pieces
overlap by a window less a word). Its words are coded by the phrases' vocabulary; a run of other words
becomes one separator, which no phrase holds, as does the end of a document. The shard's suffixes are
sorted; the last column goes into a wavelet matrix; all phrases are searched backward at once through its
ranks; occurrences are located by walking to sampled suffix positions; spans are merged per document. No
shuffle: a document lies whole in one partition. A phrase is a place in its item's word codes. Items go to
the executors by broadcast in blocks of at most ``block_bytes`` of text (an item lies whole in one); with more
than one block, one after the other is collected, searched and dropped, and the spans of a row are merged by
its row key.

Defined cases: a null or empty text has no words and no hits, a null benchmark text no windows; a null
item id marks words but isn't listed; a null document id stays null; repeated rows are judged each; an
item in several rows counts once; empty tables give no rows, or rows without hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, lean, runs_of_words, slices, texts_of, unused, written

WINDOW = 13
#: Text bytes of a shard, words of one, and text bytes of the items broadcast at once.
SHARD_BYTES, SHARD_WORDS = 4 << 20, 1 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16
_END = np.ones(1, np.int32)
_KEPT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """A text as UTF-8, A-Z lower-cased, all ASCII but digits and letters as spaces."""
    return text.encode("utf-8", "replace").translate(_FOLD)


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, all ASCII but digits and letters separates."""
    return folded(text).split()


class _Codes(dict):
    """Words to codes; 1 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return 1


class Phrases:
    """The windows of items, as places in their words' codes (0 ends a shard, 1 separates)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window, self.vocabulary = window, _Codes()
        self.names = sorted({x for x, _ in items if x is not None})
        at = {x: i for i, x in enumerate(self.names)}
        coded = []
        for _, text in items:
            ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in ws], np.int32) for ws in runs_of_words(folded(text))]
            coded.append(np.concatenate([np.zeros(0, np.int32), *ids]))
        size = np.array([len(x) for x in coded], np.int64)
        count = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        begin = np.cumsum(size) - size
        self.codes = np.concatenate([np.zeros(0, np.int32), *coded])
        self.starts = (np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())).astype(np.int32)
        self.lengths = np.repeat(np.minimum(size, window), count).astype(np.int16)
        self.items = np.repeat(np.array([at.get(x, -1) for x, _ in items], np.int32), count)  # -1: without a name

    def coded(self, text: str) -> np.ndarray:
        get = self.vocabulary.__getitem__
        return np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(get, ws), np.int32, len(ws)) for ws in runs_of_words(folded(text)))])


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes; ``text`` ends with its only 0. Prefix doubling over the suffixes still tied."""
    n, width = len(text), max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        sub = order[tied]
        key = rank[sub] * (n + 1) + np.where(sub + width < n, rank[np.minimum(sub + width, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[tied], key = sub[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class FMIndex:
    """Counts and places of word sequences in a coded text."""

    def __init__(self, text: np.ndarray, n_codes: int, sample: int = SAMPLE):
        bits = max(1, int(n_codes - 1).bit_length())
        order = suffix_array(text, bits)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_codes))])
        sampled = order % sample == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled, dtype=np.int64)])
        self.places = order[sampled]
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):  # wavelet matrix: by each bit, zeros before ones
            bit = (last >> b & 1).astype(bool)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(last) - int(self.ones[-1][-1]))
            last = np.concatenate([last[~bit], last[bit]])
        codes = np.arange(n_codes)
        self.first = self._down(codes, np.zeros(n_codes, np.int64))

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[at].astype(np.int64)
            at = np.where(code >> (self.bits - 1 - k) & 1, zeros + one, at - one)
        return at

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code stands in the last column before each row."""
        return self._down(code, at) - self.first[code]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases: those that occur, with their first row and the row after their last."""
        n, lengths = len(phrases.starts), phrases.lengths
        live = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, int(self.before[-1]), np.int64)
        for k in range(phrases.window):
            todo = live[lengths[live] > k]
            c = phrases.codes[phrases.starts[todo] + lengths[todo] - 1 - k].astype(np.int64)
            low[todo] = self.before[c] + self.rank(c, low[todo])
            high[todo] = self.before[c] + self.rank(c, high[todo])
            live = live[low[live] < high[live]]
        return live, low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the text until a sampled suffix."""
        found, step, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        at = rows.copy()
        while len(live):
            here = self.sampled[at[live]]
            hit = self.sampled[at[live] + 1] > here
            found[live[hit]] = self.places[here[hit]] + step
            live, step = live[~hit], step + 1
            down, code = at[live], np.zeros(len(live), np.int64)
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                one = ones[down].astype(np.int64)
                bit = ones[down + 1] > one
                down, code = np.where(bit, zeros + one, down - one), code << 1 | bit
            at[live] = self.before[code] + down - self.first[code]
        return found


def _pieces(coded: list[np.ndarray], window: int, most: int):
    """Runs of words of at most ``most`` in all, as ``(text, first word, codes)``; longer texts in pieces that overlap."""
    held, n = [], 0
    for d, x in enumerate(coded):
        for at in range(0, max(1, len(x) - window + 1), most):
            piece = x[at : at + most + window - 1]
            if held and n + len(piece) > most:
                yield held
                held, n = [], 0
            held.append((d, at, piece))
            n += len(piece) + 1
    if held:
        yield held


def _hits(pieces: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases' occurrences the text, the first word, and the phrase."""
    full = np.concatenate([y for _, _, x in pieces for y in (x, _END)])
    kept = np.flatnonzero(np.concatenate([[True], (full[1:] != 1) | (full[:-1] != 1)]))
    index = FMIndex(np.append(full[kept], np.int32(0)), len(phrases.vocabulary) + 2)
    which, low, high = index.search(phrases)
    n = high - low
    ends = np.cumsum(n)
    rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + n, n)
    at = kept[index.locate(rows)]  # among all words and ends of pieces
    size = np.array([len(x) + 1 for _, _, x in pieces])
    piece = np.searchsorted(np.cumsum(size), at, "right")
    first, text = (np.array([x[k] for x in pieces]) for k in (1, 0))
    return text[piece], at - (np.cumsum(size) - size)[piece] + first[piece], np.repeat(which, n)


def search_shard(texts: list[str], phrases: Phrases, most: int = SHARD_WORDS) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text the number of words, the merged spans of hit words, and the items with occurring windows."""
    coded = [phrases.coded(x) for x in texts]
    counts = np.array([len(x) for x in coded], np.int64)
    spans, items = [[] for _ in texts], [[] for _ in texts]
    if not len(phrases.starts) or not len(texts):
        return counts, spans, items
    text, at, which = (np.concatenate(x) for x in zip(*(_hits(x, phrases) for x in _pieces(coded, phrases.window, most)), strict=True))
    if not len(text):
        return counts, spans, items
    starts = np.cumsum(counts + 1) - counts - 1
    begin = starts[text] + at
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate((begin + phrases.lengths[which])[order])
    new = np.append(True, begin[1:] > end[:-1])
    of = text[order][new]
    stop = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    for d, a, b in zip(of.tolist(), (begin[new] - starts[of]).tolist(), (stop - starts[of]).tolist(), strict=True):
        spans[d].append((a, b))
    for d, i in np.unique(np.stack([text, phrases.items[which]]), axis=1).T.tolist():
        if i >= 0:
            items[d].append(phrases.names[i])
    return counts, spans, [sorted(x) for x in items]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code point spans, end exclusive."""
    if not spans:
        return []
    at = [m.span() for m in _KEPT.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def _blocks(benchmark: DataFrame, block_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length(F.col("text"))).alias("n")).first()["n"] or 0
    return max(1, -(-total // block_bytes))


def _shared(benchmark: DataFrame, item_col: str, n_blocks: int, k: int, window: int):
    """A block's phrases, broadcast."""
    part = benchmark if n_blocks == 1 else benchmark.where(F.pmod(F.xxhash64(F.col(item_col)), F.lit(n_blocks)) == k)
    items = [(r[0], r[1] or "") for r in part.select(F.col(item_col).cast("string"), F.col("text").cast("string")).collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Phrases(items, window))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, n_words, n_hit, items, spans, chars`` for every row: item ids, hit word spans, code point spans."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    n_blocks = _blocks(benchmark, block_bytes)
    span = "array<struct<start:bigint,end:bigint>>"

    def searched(shared):
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", SHARD_BYTES):
                    texts = texts_of(part)
                    counts, spans, items = search_shard(texts, shared.value)
                    chars = [char_spans(t, s) for t, s in zip(texts, spans, strict=True)]
                    hit = [sum(b - a for a, b in s) for s in spans]
                    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    pairs = [pa.array([[{"start": a, "end": b} for a, b in s] for s in x], kinds) for x in (spans, chars)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), *pairs], ["id", "row", "n_words", "n_hit", "items", "spans", "chars"])

        return source.mapInArrow(lean(run), f"id {kind}, row long, n_words long, n_hit long, items array<string>, spans {span}, chars {span}")

    if n_blocks == 1:
        return searched(_shared(benchmark, item_col, 1, 0, window)).drop("row").withColumnRenamed("id", id_col)
    every = None
    for k in range(n_blocks):
        shared = _shared(benchmark, item_col, n_blocks, k, window)
        part = written(searched(shared), "hits")
        shared.destroy()
        every = part if every is None else every.unionByName(part)

    def merged(name: str):
        """Spans of all blocks in order, those that touch made one."""
        step = f"""aggregate(array_sort(flatten(collect_list({name}))), cast(array() as {span}), (s, x) ->
            case when size(s) > 0 and element_at(s, -1).end >= x.start
            then concat(slice(s, 1, size(s) - 1), array(named_struct('start', element_at(s, -1).start, 'end', greatest(element_at(s, -1).end, x.end))))
            else concat(s, array(x)) end)"""
        return F.expr(step).alias(name)

    one = every.groupBy("row").agg(F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged("spans"), merged("chars"))
    return one.select(id_col, "n_words", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_hit"), "items", "spans", "chars")


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``find``'s rows."""
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows; the other rows and all columns stay as they are."""
    spark = docs.sparkSession
    bound_batches(spark)
    if _blocks(benchmark, block_bytes) > 1:
        key = unused(docs, "row")
        keyed = docs.withColumn(key, F.monotonically_increasing_id())
        bad = find(keyed.select(F.col(key).alias("id"), F.col(text_col).alias("text")), benchmark, "id", window=window, block_bytes=block_bytes).where(contaminated(F.col("n_hit"), F.col("n_words")))
        return keyed.join(bad.select(F.col("id").alias(key)), key, "left_anti").select(*docs.columns)
    shared = _shared(benchmark, "item_id", 1, 0, window)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, SHARD_BYTES):
                counts, spans, _ = search_shard(texts_of(part, text_col), shared.value)
                hit = np.array([sum(b - a for a, b in s) for s in spans], np.int64)
                yield part.filter(pa.array((hit == 0) | (20 * hit < counts)))

    return docs.mapInArrow(lean(run), docs.schema)
