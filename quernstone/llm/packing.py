"""Packing of documents into token sequences by bin completion.

Only how many pieces there are of each length matters to the packing, and there
are no more lengths than a sequence has tokens; so the search runs on that
histogram, on the driver, however many documents there are. Best fit over the
histogram, and a quick search among bins of at most four pieces, give the
incumbent. Bin completion then takes the largest length left, enumerates the
undominated fillings of the room around it, of any number of pieces, by the sums
that the histogram reaches, and repeats the chosen bin as often as the histogram
and the waste allow, or later fewer times; a branch ends when its waste leaves
no chance to beat the incumbent. Pieces are numbered within their length, in two
levels so that a length that a third of them have is spread over many tasks, and
the numbers lead to places in sequences.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import BROADCAST_ROWS, Memory, give_back, map_batches, slices, stored, worker_state

CAPACITY = 4096
END = 1
#: Bins that the quick search may try beyond its first descent.
QUICK_NODES = 3000
#: Steps of the search's work: fillings looked at, branches cut, an eighth of the lengths listed.
NODES = 500_000
#: Steps whose state of enumeration is held; that of earlier ones is made again when the search comes back.
HELD = 64

Bin = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def salts_of(n: int) -> int:
    """Over how many tasks n pieces of one length are spread: of 100 each up to 64, and
    as many of 20,000 beyond."""
    return min(-(-n // 100), max(64, -(-n // 20_000)))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Stretches of text whose ids a worker remembers.
REMEMBERED = 150_000


class TokenBytes:
    """Little-endian 32-bit token ids of texts, by stretches between ASCII white space.

    The tokenizer drops white space, lowers case and never joins across white space
    or from a letter to a mark, so a text's ids are those of its stretches in order,
    with A-Z in lower case and a space between an ASCII letter and a mark; each
    distinct one of many texts is encoded once. An apostrophe is no mark here, for
    the tokenizer joins some letters to it.
    """

    MARK_AFTER_LETTER = r"([a-z])([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~])"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), Memory(remembered)

    def _encode(self, words: list[str], letters: bool) -> list[bytes]:
        """The ids of each. Words of letters only are one pre-token each, so many are
        encoded as one text, whose ids say which of them they belong to."""
        out, step = [], 4096
        for at in range(0, len(words), step):
            part = words[at : at + step]
            if letters:
                e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                word = np.array(e.word_ids, np.int64)
                if len(word) and word[-1] == len(part) - 1:
                    raw = np.array(e.ids, "<u4").tobytes()
                    ends = (4 * np.searchsorted(word, np.arange(len(part)), "right")).tolist()
                    out += [raw[a:b] for a, b in zip([0, *ends], ends)]
                    continue
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new stretches."""
        out: list[bytes] = [b""] * len(new)
        letters = [x.isalpha() and (x.isascii() or x.lower().isalpha()) for x in new]
        for kind in (True, False):
            rows = [i for i, x in enumerate(letters) if x is kind]
            for i, ids in zip(rows, self._encode([new[i] for i in rows], kind)):
                out[i] = ids
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each string; null is empty."""
        column = pc.fill_null(column, "")
        spread = pc.replace_substring_regex(pc.ascii_lower(column), self.MARK_AFTER_LETTER, r"\1 \2")
        # names of special tokens, which the tokenizer finds in texts, stay as they are
        stretches = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(column, "<|"), column, spread))
        coded = stretches.flatten().dictionary_encode()
        known = self.memory.known(coded.dictionary.to_pylist(), self._learn)
        size = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        every = np.frombuffer(b"".join(known), "<u4")
        which = coded.indices.to_numpy()
        n, first = size[which], (np.cumsum(size) - size)[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(ends[-1])
        at += np.repeat(first - ends[:-1], n)
        ids = every[at].tobytes()
        ends = (4 * ends[np.concatenate(([0], np.cumsum(stretches.value_lengths().to_numpy())))]).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids as bytes.

    A document is the ids of its text and the end id; a null text is empty. Only
    one longer than capacity is cut. Each row of docs is a document.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *PIECE, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    width = 4 * capacity

    def run(batches):
        import zlib

        from pyspark.sql.pandas.types import to_arrow_schema

        tokens = worker_state("token bytes", (path,), lambda: TokenBytes(path))  # words come again in a worker's next task
        out, last = to_arrow_schema(schema), np.array([end], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[list] = [[] for _ in out]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1))):
                ids += last
                for n, a in enumerate(range(0, len(ids), width)):
                    part = ids[a : a + width]
                    for x, y in zip(rows, (doc, n, a // 4, len(part) // 4, zlib.crc32(part), part)):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, out)], schema=out)
            rows = []
            give_back()  # what a slice took beside its memory is a third of a worker

    return map_batches(docs.select("doc_id", "text"), run, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Best fit decreasing, with equal bins kept together."""
    open_bins: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room: int, content: Bin, n: int) -> None:
        open_bins.setdefault(room, []).append([content, n])
        rooms[room] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                    left %= each
                if left:
                    put(capacity - left * length, ((length, left),), 1)
                break
            room = length + int(fits[0])
            group = open_bins[room][-1]
            each = min(room // length, left)
            n = min(group[1], left // each)
            group[1] -= n
            rooms[room] -= n
            if not group[1]:
                open_bins[room].pop()
            put(room - each * length, (*group[0], (length, each)), n)
            left -= n * each
    return [(content, n) for groups in open_bins.values() for content, n in groups if n]


class _Room:
    """The lengths left, for finding fillings of at most three items."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.below = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))

    def fillings(self, room: int, most: int) -> list[tuple[int, ...]]:
        """Some fillings, fullest first, at most so many. One item of the
        largest fitting length dominates all that fit into its place; a pair or
        more stands only if it fills more than that, each with the largest
        partner that fits."""
        one = int(self.below[room])
        if not one:
            return [()]
        found = {(one,): one}
        if one < room:
            self._pairs(room, one, found, most, ())
            if max(found.values()) < room:
                firsts = np.flatnonzero(self.counts[: room + 1])[::-1][:24]
                for a in firsts.tolist():
                    self.counts[a] -= 1
                    rest = room - a
                    small = int(self.below[rest])
                    if small and (small != a or self.counts[a] > 0):
                        self._pairs(rest, small, found, 2, (a,))
                    self.counts[a] += 1
                    if max(found.values()) == room:
                        break
        return sorted(found, key=lambda x: (-found[x], len(x), [-y for y in x]))[:most]

    def _pairs(self, room: int, one: int, found: dict, most: int, before: tuple[int, ...]) -> None:
        a = np.flatnonzero(self.counts[: room + 1] > 0)
        b = self.below[room - a]
        ok = (b > 0) & (b <= a) & ((a != b) | (self.counts[a] > 1)) & (a + b > one)
        for x in before:
            ok &= ((b != x) | (self.counts[x] > 0)) & ((a != x) | (self.counts[x] > 0))
        a, b = a[ok], b[ok]
        for i in np.argsort(-(a + b), kind="stable")[:most].tolist():
            items = tuple(sorted((*before, int(a[i]), int(b[i])), reverse=True))
            found[items] = sum(items)


def quick_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = QUICK_NODES) -> list[tuple[Bin, int]]:
    """Bins (content, how often) that hold the histogram: those of a search among
    few bins of at most four items if it beats best fit, else those of best fit."""
    incumbent = best_fit(histogram, capacity)
    total = sum(length * n for length, n in histogram.items())
    bound = -(-total // capacity)
    used = lambda bins: sum(n for _, n in bins)
    start = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        start[length] = n
    stack: list[tuple[np.ndarray, list, int, tuple[int, ...] | None]] = [(start, [], 0, None)]
    while stack and used(incumbent) > bound and nodes > 0:
        counts, bins, waste, chosen = stack.pop()
        spare = (used(incumbent) - 1) * capacity - total
        counts, bins, first = counts.copy(), list(bins), True
        while waste <= spare:
            there = np.flatnonzero(counts)
            if not len(there):
                incumbent = bins
                break
            largest = int(there[-1])
            if first and chosen is not None:
                filling = chosen
            else:
                counts[largest] -= 1
                options = _Room(counts).fillings(capacity - largest, 3)
                counts[largest] += 1
                filling = options[0]
                if len(stack) < 64:
                    stack += [(counts.copy(), list(bins), waste, o) for o in options[:0:-1]]
            first = False
            content = Counter((largest, *filling))
            often = min(int(counts[x]) // n for x, n in content.items())
            for x, n in content.items():
                counts[x] -= n * often
            bins.append((tuple(sorted(content.items(), reverse=True)), often))
            waste += often * (capacity - largest - sum(filling))
            nodes -= len(stack) > 2
    return incumbent


class Search:
    """Bin completion with fillings of any number of items. A step fills bins
    around the largest length left; `budget` is the only thing that ends it early."""

    def __init__(self, histogram: dict[int, int], capacity: int, budget: int):
        self.capacity, self.budget = capacity, budget
        self.counts = [0] * (capacity + 1)
        for length, n in histogram.items():
            self.counts[length] = n

    def fillings(self, room: int, least: int) -> Iterator[tuple[Bin, int]]:
        """Undominated fillings (content, sum) of at least so many tokens, fullest
        first, those of longer items before others.

        A filling is dominated if a length left over can replace items in it whose
        sum is as large (two or more items), or less by no more than the room left
        (any items, or none).
        """
        counts = self.counts
        lengths = [x for x in range(room, 0, -1) if counts[x]]
        first_at = [0] * (room + 1)  # place of the longest length that fits
        at = len(lengths)
        for x in range(room + 1):
            while at and lengths[at - 1] <= x:
                at -= 1
            first_at[x] = at
        # bit t of reach[i]: t is a sum of items of lengths[i:]
        reach, mask = [1] * (len(lengths) + 1), (1 << (room + 1)) - 1
        for i in range(len(lengths) - 1, -1, -1):
            bits, left, step = reach[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
            while left > 0:
                bits |= bits << (lengths[i] * min(step, left))
                left, step = left - step, step * 2
            reach[i] = bits & mask
        free = sum(1 << x for x in lengths)
        self.budget -= 1 + len(lengths) // 8

        def reached(sums: int, slack: int) -> int:
            """Bits of what is up to slack more than a sum, but not a sum's own."""
            sums, width = sums << 1, 1
            while width < slack:
                step = min(width, slack - width)
                sums, width = sums | sums << step, width + step
            return sums if slack else 0

        def walk(i: int, rest: int, slack: int, picked: Bin, one: int, more: int, free: int):
            """Fillings whose other items are of lengths[i:] and sum to rest. one and
            more: bits of the sums of one and of several picked items."""
            if not rest:
                self.budget -= 1
                if not free & (1 << slack + 1) - 1:  # nothing fits beside it
                    yield picked
                return
            for j in range(max(i, first_at[rest]), len(lengths)):
                if self.budget <= 0 or not reach[j] >> rest & 1:
                    return
                x, now_one, now_more, options = lengths[j], one, more, []
                for n in range(1, min(counts[x], rest // x) + 1):
                    now_more |= (now_one | now_more) << x
                    now_one |= 1 << x
                    now_free = free & ~(1 << x) if n == counts[x] else free
                    if (now_more | reached(now_one | now_more, slack)) & now_free:  # so are all with more of it
                        self.budget -= 1
                        break
                    if reach[j + 1] >> (rest - n * x) & 1:
                        options.append((n, now_one, now_more, now_free))
                for n, now_one, now_more, now_free in reversed(options):
                    yield from walk(j + 1, rest - n * x, slack, (*picked, (x, n)), now_one, now_more, now_free)

        for total in range(room, max(least, 0) - 1, -1):
            if reach[0] >> total & 1:
                for content in walk(0, total, room - total, (), 0, 0, free):
                    yield content, total

    def options(self, largest: int, spare: int) -> Iterator[tuple[Bin, int, int]]:
        """(bin, how often, waste of all): each filling as often as it goes, then fewer times."""
        room = self.capacity - largest
        for fewer in (False, True):
            self.counts[largest] -= 1
            found = self.fillings(room, room - spare)
            while True:
                got = next(found, None)
                if got is None:
                    break
                self.counts[largest] += 1  # as outside while suspended
                content = Counter({largest: 1})
                for x, n in got[0]:
                    content[x] += n
                slack = room - got[1]
                often = min(self.counts[x] // n for x, n in content.items())
                if slack:
                    often = min(often, spare // slack)
                bin_ = tuple(sorted(content.items(), reverse=True))
                for n in range(often - 1, 0, -1) if fewer else (often,):
                    if fewer:
                        self.budget -= 1
                    yield bin_, n, n * slack
                    if self.budget <= 0:
                        return
                self.counts[largest] -= 1
            self.counts[largest] += 1

    def put(self, content: Bin, often: int) -> None:
        for x, n in content:
            self.counts[x] -= n * often

    def descend(self, incumbent: list[tuple[Bin, int]], total: int, bound: int, late: int) -> tuple[list[tuple[Bin, int]], bool]:
        """The best bins found by paths whose choices stand at most `late` places
        after the first ones, taken together, and whether there were later ones.
        Nothing is placed when it returns with budget left."""
        used = lambda bins: sum(n for _, n in bins)
        # largest, spare waste and places when begun, options, how many are taken, what is placed, its waste
        steps: list[list] = []
        spare, strayed, cut, down = (used(incumbent) - 1) * self.capacity - total, 0, False, True
        while self.budget > 0:
            if down:
                largest = next((x for x in range(steps[-1][0] if steps else self.capacity, 0, -1) if self.counts[x]), 0)
                if largest:
                    steps.append([largest, spare, strayed, self.options(largest, spare), 0, None, 0])
                    if len(steps) > HELD:
                        steps[-1 - HELD][3] = None
                else:
                    better = [step[5] for step in steps]
                    spare -= (used(incumbent) - used(better)) * self.capacity
                    incumbent = better
                    if used(incumbent) <= bound:
                        break
            if not steps:
                break
            step = steps[-1]
            if step[5] is not None:
                self.put(step[5][0], -step[5][1])
                spare += step[6]
                strayed, step[5] = step[2], None
            got = None
            if step[2] + step[4] <= late:
                if step[3] is None:
                    step[3] = self.options(step[0], step[1])
                    for _ in range(step[4]):
                        next(step[3], None)
                got = next(step[3], None)
            else:
                cut = True
            down = got is not None and got[2] <= spare
            if got is None:
                steps.pop()
            else:
                step[4] += 1
                if down:
                    self.put(got[0], got[1])
                    step[5], step[6], strayed = (got[0], got[1]), got[2], step[2] + step[4] - 1
                    spare -= got[2]
        return incumbent, cut


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Bin, int]]:
    """Bins (content, how often) that hold the histogram: those of the search if
    it beats the quick search and best fit, else theirs."""
    incumbent = quick_bins(histogram, capacity)
    total = sum(length * n for length, n in histogram.items())
    bound = -(-total // capacity)
    used = lambda bins: sum(n for _, n in bins)
    if used(incumbent) <= bound:
        return incumbent
    search, late = Search(histogram, capacity, nodes), 0
    # passes that stray from the first choices in more and more steps, until one had no need to stop for that
    while search.budget > 0 and used(incumbent) > bound:
        incumbent, cut = search.descend(incumbent, total, bound, late)
        if not cut:
            break
        late = 2 * late or 1
    return incumbent


def slots_of(bins: list[tuple[Bin, int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, how many in each, offset)."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, often in bins:
        offset = 0
        for length, each in content:
            rows.append((length, taken[length], sequence, each, offset))
            taken[length] += each * often
            offset += each * length
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a stored table: it is
    read for the histogram first and then for the numbers."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # no more than capacity
    slots = slots_of(complete_bins(histogram, capacity))
    keys = (slots[:, 0] << 44) + slots[:, 1]
    salts = pieces.sparkSession.createDataFrame([(x, salts_of(n)) for x, n in histogram.items()], f"length {dict(pieces.dtypes)['length']}, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    counts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "length-counts")
    by_length = Window.partitionBy("length").orderBy("salt")
    before = counts.select("length", "salt", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    few = counts.count() <= BROADCAST_ROWS
    numbered = salted.join(F.broadcast(before) if few else before, ["length", "salt"])
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = numbered.withColumn("number", F.col("before") + F.row_number().over(order) - 1).drop("before", "salt")
    kept = [f for f in pieces.schema]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(x)).to_numpy().astype(np.int64) for x in ("length", "number"))
            row = slots[np.searchsorted(keys, (length << 44) + number, "right") - 1] if len(length) else slots[:0]
            since = number - row[:, 1]
            sequence, offset = row[:, 2] + since // np.maximum(row[:, 3], 1), row[:, 4] + since % np.maximum(row[:, 3], 1) * length
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=schema.names)

    return map_batches(numbered.select(*[f.name for f in kept], "number"), run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    Sequences have at most capacity tokens, without gaps. A null text is an empty
    document, which is the end id alone; a row with a null id is a document like
    others; repeated rows are packed each. A table without rows gives none.
    """
    return packed(stored(token_pieces(docs, path or tokenizer_path(), capacity, end), "pieces"), capacity)
