"""Problem 4: pairs of near-duplicate records, by adaptive multi-match prefixes.

A record is the set of its shingles (hashes of three consecutive words), in an
order from rare to frequent. Two sets that share at least `a` shingles share at
least m of the first |x| - a + m of either. Longer prefixes (a larger m) cost
more keys, but a pair must then agree in more of them.

To ask for more than one common shingle without counting over all pairs, the
prefix is dealt into g groups by hash, and m = (w - 1) g + 1: some group then
holds w common shingles, and each w shingles of a group make one key. The width
w (1, 2 or 3) is chosen for each size class from the candidates that the
shingles' frequencies let expect, so that records of many frequent shingles get
longer prefixes. All of this is exact: no pair over the threshold is missed.

Roles: of a pair the smaller set brings its (shorter) index prefix, the larger
one its probe prefix. g and w depend on the size class of the larger one, so a
record brings index keys for its own class and for the classes above that it
can still be similar to.

Equal sets have one id, so copies meet as one entry of a key however many they
are. Keys travel as packed blocks, one for each range of keys, with a bitmap of
each set that rules out nearly all false candidates where the keys meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import add_slices, may_be_in
from talefold.session import stage, unstage

WORD = re.compile(r"[^\W_]+")
SHINGLE = 3
THRESHOLD = 0.6
LEAST_WORDS = 20
#: Frequencies are counted in so many buckets of the hash (4 MB, whatever the size of the corpus).
BUCKETS = 1 << 20
#: 64-bit words of a set's bitmap.
BITMAP = 4
#: Keys that one task joins, about; the number of key ranges follows from it.
KEYS_PER_TASK = 6_000_000
#: A key (made, shuffled, sorted) costs about as much as so many candidates that are checked by their bitmaps, as measured.
CANDIDATES_PER_KEY = 12
#: Records that share a shingle, about, up to which one task pairs them all; the key of a more frequent one is split.
HOT = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Sets of one batch at most, so that a set's number and a 52-bit hash make one sortable word.
BATCH = 4096
_LOW = np.uint64(0xFFFFFFFF)
_WORD, _OWNER_BITS = np.uint64(64), np.uint64(12)
#: Sizes of one class differ by less than this factor.
_CLASS_BASE = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hash of each word; the memory is bounded."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return begin, np.diff(np.append(begin, len(sorted_values)))


def _count_up(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Shingler:
    """Sets of a batch of at most BATCH rows as flat arrays; a shingle is the upper 52 bits of its hash."""

    def __init__(self, shingle: int, least_words: int):
        self.memory, self.shingle, self.least = _Words(), shingle, least_words

    def __call__(self, titles: list, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that take part, the size of each one's set, and the sets, each sorted by hash."""
        codes: list[int] = []
        rows, lengths = [], []
        get = self.memory.__getitem__
        for row, (title, text) in enumerate(zip(titles, texts)):
            if text is None or len(body := WORD.findall(text.lower())) < self.least:
                continue
            head = WORD.findall(title.lower()) if title else []
            codes += map(get, head)
            codes += map(get, body)
            rows.append(row)
            lengths.append(len(head) + len(body))
        n = np.array(lengths, np.int64)
        h = np.array(codes, np.uint64)
        doc = np.repeat(np.arange(len(n)), n)
        if not len(n):
            return np.zeros(0, np.int64), n, h
        last = len(h) - self.shingle + 1
        x = np.zeros(max(last, 0), np.uint64)
        for k in range(self.shingle):
            x = _mix(x + h[k : k + len(x)] + np.uint64(k + 1))
        inside = doc[: len(x)] == doc[self.shingle - 1 : self.shingle - 1 + len(x)]
        packed = (x[inside] >> _OWNER_BITS) | (doc[: len(x)][inside].astype(np.uint64) << (_WORD - _OWNER_BITS))
        packed.sort()
        first = np.ones(len(packed), bool)
        first[1:] = packed[1:] != packed[:-1]
        packed = packed[first]
        x, doc = packed << _OWNER_BITS, (packed >> (_WORD - _OWNER_BITS)).astype(np.int64)
        size = np.bincount(doc, minlength=len(n))
        some = size > 0  # a lone word or two have no shingle
        return np.array(rows, np.int64)[some], size[some], x


def set_ids(size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (signed, as Spark has it)."""
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_mix(x), begin) if len(size) else np.zeros(0, np.uint64)
        return _mix(total + size.astype(np.uint64) * _MIX).view(np.int64)


def bitmaps(size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """BITMAP words for each set: bit b is the parity of its shingles with hash b. Bits that differ are shingles that differ."""
    out = np.zeros((len(size), BITMAP), np.uint64)
    bit = (_mix(x + np.uint64(5)) >> np.uint64(20)) % np.uint64(64 * BITMAP)
    mask = np.uint64(1) << (bit % np.uint64(64))
    begin = np.cumsum(size) - size
    for word in range(BITMAP):
        part = np.where(bit // np.uint64(64) == word, mask, np.uint64(0))
        if len(size):
            out[:, word] = np.bitwise_xor.reduceat(part, begin)
    return out


def bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(_CLASS_BASE) + 1e-9).astype(np.int64)


def class_bounds(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest size in a class."""
    low = np.ceil(_CLASS_BASE ** k - 1e-6).astype(np.int64)
    return low, np.ceil(_CLASS_BASE ** (k + 1) - 1e-6).astype(np.int64) - 1


def needed(total: np.ndarray, t: float) -> np.ndarray:
    """Common shingles that two sets of `total` shingles together need at least."""
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def groups(k: np.ndarray, width: np.ndarray, t: float) -> np.ndarray:
    """g of a class: about the base prefix, and m never over what the smallest pair shares."""
    low = class_bounds(k)[0]
    most = (needed(low + np.ceil(t * low - 1e-9), t) - 1) // np.maximum(width - 1, 1)
    share = np.where(width == 3, 0.25, 0.4)
    return np.maximum(1, np.minimum(np.floor(share * low).astype(np.int64), most))


def prefix(n: np.ndarray, partner: np.ndarray, k: np.ndarray, width: np.ndarray, t: float) -> np.ndarray:
    """Prefix of a set of n against partners of at least `partner`, with the g and width of class k."""
    m = (width - 1) * groups(k, width, t) + 1
    need = needed(n + partner, t)
    # where even the smallest pair shares fewer than m, its full sets are the prefix
    return np.minimum(n, n - need + np.minimum(m, need)).astype(np.int64)


def subsets(x: np.ndarray, owner: np.ndarray, group: np.ndarray, width: int, flag: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each `width` shingles of the same owner and group as one key: key, owner, whether all are flagged, and how often its rarest one occurs."""
    x = _mix(x)
    often = np.zeros(len(x), np.int64) if often is None else often
    if width == 1:
        return _mix(x), owner, flag, often
    place = (owner << 40) | group
    order = np.argsort(place)
    x, owner, flag, place, often = x[order], owner[order], flag[order], place[order], often[order]
    begin, length = _runs(place)
    rest = np.repeat(begin + length, length) - np.arange(len(x)) - 1
    i = np.repeat(np.arange(len(x)), rest)
    j = i + 1 + _count_up(rest)
    key, mark, few = x[i] + x[j], flag[i] & flag[j], np.minimum(often[i], often[j])
    if width == 2:
        return _mix(key), owner[i], mark, few
    rest = rest[j]
    a = np.repeat(np.arange(len(j)), rest)
    b = j[a] + 1 + _count_up(rest)
    return _mix(key[a] + x[b]), owner[i[a]], mark[a] & flag[b], np.minimum(few[a], often[b])


def split_hot(key: np.ndarray, owner: np.ndarray, often: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of more than HOT records as several: their records are dealt into groups by name, and each two groups (and each with itself) meet under a key of their own.

    So no task pairs more than two groups, and no pair is missed. The lowest bit
    of a key, which tells an index key, stays.
    """
    hot = often > HOT
    if not hot.any():
        return key, owner
    parts = -(-often[hot] // HOT)
    mine = (_mix(names.view(np.uint64)[owner[hot]]) % parts.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.flatnonzero(hot), parts)
    other = _count_up(parts)
    mine = np.repeat(mine, parts)
    low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
    one = np.uint64(1)
    split = (_mix((key[at] & ~one) + _mix((low << np.uint64(32)) + high + one)) & ~one) | (key[at] & one)
    return np.concatenate([key[~hot], split]), np.concatenate([owner[~hot], owner[at]])


def signatures(size: np.ndarray, x: np.ndarray, frequency: np.ndarray, widths: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a batch of sets: key (its lowest bit tells an index key), owner."""
    names = set_ids(size, x)
    owner = np.repeat(np.arange(len(size)), size)
    rank = np.minimum(frequency[bucket(x)], 0xFFFF).astype(np.uint64)
    x = x[np.argsort((owner.astype(np.uint64) << (_WORD - _OWNER_BITS)) | (rank << np.uint64(36)) | (x >> np.uint64(28)))]
    often = frequency[bucket(x)].astype(np.int64) - int(frequency.mean())  # without what chance puts into each bucket
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    own = size_class(size)
    keys, owners = [], []

    def add(who: np.ndarray, k: np.ndarray, index: np.ndarray, probe: np.ndarray) -> None:
        """Keys of the sets `who` with the parameters of class k, from prefixes of these lengths."""
        spread = np.full(len(size), -1, np.int64)
        spread[who] = np.arange(len(who))
        at = spread[owner]
        for width in (1, 2, 3):
            use = (at >= 0) & (widths[k][at] == width) & (place < np.maximum(index, probe)[at])
            if use.any():
                mine, c = owner[use], k[at[use]]
                g = groups(c, np.full(len(c), width), t).astype(np.uint64)
                deal = (_mix(x[use] + np.uint64(11)) >> np.uint64(20)) % (g if width > 1 else np.uint64(1))
                key, who_of, flag, few = subsets(x[use], mine, deal.astype(np.int64), width, place[use] < index[at[use]], often[use])
                key = _mix(key + c_of(c, mine, who_of))
                key, who_of = split_hot((key & ~np.uint64(1)) | flag.astype(np.uint64), who_of, few, names)
                keys.append(key)
                owners.append(who_of)

    def c_of(c: np.ndarray, mine: np.ndarray, who_of: np.ndarray) -> np.ndarray:
        """The class as part of the key, so that keys of other classes don't meet."""
        table = np.zeros(len(size), np.uint64)
        table[mine] = c
        return table[who_of]

    everyone = np.arange(len(size))
    w = widths[own]
    low = class_bounds(own)[0]
    smallest = np.ceil(t * size - 1e-9).astype(np.int64)
    add(everyone, own, prefix(size, np.maximum(size, low), own, w, t), prefix(size, smallest, own, w, t))
    for up in range(1, 2 + math.ceil(math.log(1 / t) / math.log(_CLASS_BASE))):
        k = own + up
        least = class_bounds(k)[0]
        who = np.flatnonzero(least <= np.floor(size / t + 1e-9))
        if len(who):
            index = prefix(size[who], least[who], k[who], widths[k[who]], t)
            add(who, k[who], index, np.zeros(len(who), np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


#: Size classes: sets of up to 2 ** 31 shingles.
CLASSES = 64


def choose_widths(cost: np.ndarray) -> np.ndarray:
    """The width of least cost for each class, 1 where a class is empty or its sets are small."""
    total = cost[:, :, 0] * CANDIDATES_PER_KEY + cost[:, :, 1]
    widths = np.where(cost[:, 0, 0] > 0, 1 + np.argmin(total, axis=1), 1)
    widths[:5] = 1  # of sets under 32, each shingle is needed
    return widths


def join_keys(packed: np.ndarray, name: np.ndarray, size: np.ndarray, bitmap: np.ndarray, t: float, block: int = 500_000) -> Iterator[np.ndarray]:
    """Candidate pairs among entries that share a key, packed as two entries; each key's list is taken in blocks.

    `packed` is sorted: 31 bits of the key, the index flag, and 32 bits of the entry.
    """
    entry, flag = (packed & _LOW).astype(np.int64), ((packed >> np.uint64(32)) & np.uint64(1)).astype(bool)
    begin, length = _runs(packed >> np.uint64(33))
    begin, length = begin[length > 1], length[length > 1]
    at = np.repeat(begin, length) + _count_up(length)
    rest = np.repeat(length, length) - _count_up(length) - 1
    at, rest = at[rest > 0], rest[rest > 0]
    edges = np.concatenate([[0], np.cumsum(rest)])
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + block, "right")) - 1)
        for a, b in _partners(at[low:high], rest[low:high], block):
            ea, eb = entry[a], entry[b]
            na, nb = size[ea], size[eb]
            ok = ((flag[a] & (na <= nb)) | (flag[b] & (nb <= na))) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9) & (ea != eb)
            ea, eb, total = ea[ok], eb[ok], (na + nb)[ok]
            apart = np.bitwise_count(bitmap[ea] ^ bitmap[eb]).sum(axis=1)
            ok = apart <= total - 2 * needed(total, t)
            ea, eb = ea[ok].astype(np.uint64), eb[ok].astype(np.uint64)
            if len(ea):
                yield np.unique((np.minimum(ea, eb) << np.uint64(32)) | np.maximum(ea, eb))
        low = high


def _partners(at: np.ndarray, rest: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, partner) places; a single entry with more partners than a block comes in parts."""
    if len(at) == 1 and rest[0] > block:
        for k in range(1, int(rest[0]) + 1, block):
            b = at[0] + np.arange(k, min(k + block, int(rest[0]) + 1))
            yield np.full(len(b), at[0]), b
    else:
        a = np.repeat(at, rest)
        yield a, a + 1 + _count_up(rest)


def _rows(df: DataFrame) -> DataFrame:
    """row_id, title, text of the rows that can take part."""
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("metadata.Title").alias("title"), F.col("text").alias("text")).where(F.col("row_id").isNotNull() & F.col("text").isNotNull())


def _members(rows: DataFrame, shingle: int, least_words: int) -> DataFrame:
    """First pass: row_id and set_id, size of each row, and each task's frequencies (kind 1) as compressed slices."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        make = Shingler(shingle, least_words)
        counts = np.zeros(BUCKETS, np.int64)
        for part in parts:
            for low in range(0, part.num_rows, 2000):
                piece = part.slice(low, 2000)
                who, size, x = make(piece.column(1).to_pylist(), piece.column(2).to_pylist())
                counts += np.bincount(bucket(x), minlength=BUCKETS)
                n = len(who)
                yield _member_batch(np.array(piece.column(0))[who], set_ids(size, x), size, np.full(n, -1), [None] * n)
        if counts.any():
            pack = zstandard.ZstdCompressor(3).compress
            blobs = [pack(s.astype(np.int64).tobytes()) for s in np.split(counts, SLICES)]
            zero = np.zeros(SLICES, np.int64)
            yield _member_batch(zero, zero, zero, np.arange(SLICES), blobs)

    return rows.mapInArrow(run, "row_id bigint, set_id bigint, n bigint, slice int, counts binary")


#: Parts in which frequencies are summed.
SLICES = 64


def _member_batch(row_id, set_id, n, slice_no, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(row_id, pa.int64()), pa.array(set_id, pa.int64()), pa.array(n, pa.int64()), pa.array(slice_no, pa.int32()), pa.array(blobs, pa.binary())],
        ["row_id", "set_id", "n", "slice", "counts"],
    )


def _frequencies(members: DataFrame) -> np.ndarray:
    """Sum of all tasks' frequencies: 4 MB on the driver, whatever the size of the corpus."""
    total = add_slices(members.where("slice >= 0").select("slice", "counts"), BUCKETS, SLICES)
    return np.minimum(total, (1 << 31) - 1).astype(np.int32)


def candidates(rows: DataFrame, frequency: np.ndarray, widths: np.ndarray, ranges: int, shingle: int, least_words: int, t: float) -> DataFrame:
    """Second pass: candidate pairs of set ids (a, b), each once."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((frequency, widths))
    labels = _labels(spark, ranges)

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle, least_words)
        freq, wide = shared.value
        for part in parts:
            for low in range(0, part.num_rows, BATCH):
                piece = part.slice(low, BATCH)
                _, size, x = make(piece.column(1).to_pylist(), piece.column(2).to_pylist())
                if not len(size):
                    continue
                name, first = np.unique(set_ids(size, x), return_index=True)
                if len(name) < len(size):  # copies within a batch go once
                    keep = np.zeros(len(size), bool)
                    keep[first] = True
                    x, size = x[np.repeat(keep, size)], size[keep]
                key, who = signatures(size, x, freq, wide, t)
                yield pack_blocks(key, who, set_ids(size, x), size, bitmaps(size, x), labels)

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[bytes]] = {}  # one range, but for a lost label
        for part in parts:
            for no, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by_range.setdefault(no, []).append(blob)
        while by_range:
            packed, name, size, bitmap = unpack_blocks(by_range.popitem()[1])
            for pair in merged(join_keys(packed, name, size, bitmap, t)):
                a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & _LOW).astype(np.int64)  # names are sorted, so a's is the smaller
                yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], ["a", "b"])

    blocks = rows.mapInArrow(emit, "range int, block binary").repartition(ranges, "range")
    return blocks.mapInArrow(meet, "a bigint, b bigint").distinct()


def _labels(spark, ranges: int) -> np.ndarray:
    """For each range a number that repartition() sends to a task of its own."""
    number = F.col("id").cast("int")
    firsts = spark.range(ranges * 64).groupBy(F.pmod(F.hash(number), F.lit(ranges)).alias("p")).agg(F.min(number).alias("label")).collect()
    out = np.arange(ranges)
    for row in firsts:
        out[row["p"]] = row["label"]
    return out


def merged(parts: Iterator[np.ndarray], rows: int = 1_000_000) -> Iterator[np.ndarray]:
    """Pairs of several blocks, each once as far as memory goes; what is left over, distinct() takes."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) > rows:
            held = [np.unique(np.concatenate(held))]
            if len(held[0]) > rows // 2:
                yield held.pop()
    if held:
        yield np.unique(np.concatenate(held))


def pack_blocks(key, who, name, size, bitmap, labels: np.ndarray) -> pa.RecordBatch:
    """For each range of keys: number of sets and keys, then names, sizes, bitmaps, keys per set, keys (32 bits of them)."""
    part = ((key >> np.uint64(33)) % np.uint64(len(labels))).astype(np.int64)
    order = np.argsort((part << 12) | who)
    part, who, low = part[order], who[order], (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    begin, length = _runs(part)
    numbers, blobs = [], []
    for b, n in zip(begin, length):
        mine = who[b : b + n]
        first, count = _runs(mine)
        sets = mine[first]
        blobs.append(
            b"".join(
                v.tobytes()
                for v in (np.array([len(sets), n], np.int64), name[sets], size[sets].astype(np.int32), bitmap[sets], count.astype(np.int32), low[b : b + n])
            )
        )
        numbers.append(labels[part[b]])
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["range", "block"])


def unpack_blocks(blobs: list[bytes]):
    keys, counts, names, sizes, maps = [], [], [], [], []
    for blob in blobs:
        n, k = np.frombuffer(blob, np.int64, 2)
        at = 16
        for out, kind, number in ((names, np.int64, n), (sizes, np.int32, n), (maps, np.uint64, n * BITMAP), (counts, np.int32, n), (keys, np.uint32, k)):
            out.append(np.frombuffer(blob, kind, number, at))
            at += out[-1].nbytes
    name, size, bitmap = np.concatenate(names), np.concatenate(sizes).astype(np.int64), np.concatenate(maps).reshape(-1, BITMAP)
    # entries of equal sets from several batches become one
    name, first, same = np.unique(name, return_index=True, return_inverse=True)
    packed = (np.concatenate(keys).astype(np.uint64) << np.uint64(32)) | np.repeat(same.astype(np.uint64), np.concatenate(counts))
    packed.sort()
    if len(first) < len(same):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return packed, name, size[first], bitmap[first]


def similar_sets(df: DataFrame, t: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Members (row_id, set_id), and pairs of different sets at `t` or more (a, b, similarity)."""
    if not 0.5 <= t < 1:
        raise ValueError("t must be from 0.5 to below 1")
    spark = df.sparkSession
    rows = _rows(df)
    first = stage(_members(rows, shingle, least_words), "neardup-members")
    members = first.where("slice < 0").select("row_id", "set_id", "n")
    frequency = _frequencies(first)
    histogram = members.groupBy(F.floor(F.log2("n") + 1e-9).alias("k")).agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).collect()
    n_sets = sum(r["sets"] for r in histogram)
    empty = spark.createDataFrame([], "a bigint, b bigint, similarity double")
    if not n_sets:
        return members.select("row_id", "set_id"), empty
    widths, keys = plan_widths({int(r["k"]): (r["sets"], r["shingles"]) for r in histogram}, frequency, n_sets, t)
    ranges = max(12, math.ceil(keys / KEYS_PER_TASK))
    pairs = stage(candidates(rows, frequency, widths, ranges, shingle, least_words, t), "neardup-candidates")
    return members.select("row_id", "set_id"), verified(rows, members, pairs, t, shingle, least_words)


def plan_widths(histogram: dict[int, tuple[int, int]], frequency: np.ndarray, n_sets: int, t: float) -> tuple[np.ndarray, float]:
    """Width of each size class and the keys to expect, from sizes and frequencies of all records.

    The frequencies, sorted and weighed by themselves, are those that a random
    set of n shingles draws from; its prefix is the rarer part of them.
    """
    f = np.sort(frequency[frequency > 0].astype(float))
    mass = np.cumsum(f)
    cost = np.zeros((CLASSES, 3, 2))
    for k, (sets, shingles) in histogram.items():
        n = np.array([max(1, round(shingles / sets))])
        kk, smallest = np.array([k]), np.ceil(t * n - 1e-9).astype(np.int64)
        for width in (1, 2, 3):
            w = np.array([width])
            length = int(prefix(n, smallest, kk, w, t)[0])
            g = int(groups(kk, w, t)[0]) if width > 1 else 1
            n_keys = sets * g * (length / g) ** width / math.factorial(width)
            part = f[: max(1, int(np.searchsorted(mass, mass[-1] * length / n[0])))]
            typical = float((part * part).sum() / part.sum())  # records with a shingle of such a prefix
            chance = typical * min(1.0, typical / n_sets) ** ((width - 1) / 2)
            cost[k, width - 1] = n_keys, n_keys * chance / 2
    widths = choose_widths(cost)
    return widths, float(cost[np.arange(CLASSES), widths - 1, 0].sum()) * 1.6


def verified(rows: DataFrame, members: DataFrame, pairs: DataFrame, t: float, shingle: int, least_words: int) -> DataFrame:
    """Exact similarity of candidate pairs; one record of each set stands for it."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    chosen = members.join(named, "set_id").groupBy("set_id").agg(F.min("row_id").alias("row_id"))
    chosen = stage(chosen, "neardup-chosen")
    texts = rows.where(may_be_in(chosen)(F.col("row_id"))).join(chosen, "row_id").select("set_id", "title", "text")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(shingle, least_words)
        for part in parts:
            for low in range(0, part.num_rows, 1000):
                piece = part.slice(low, 1000)
                who, size, x = make(piece.column(1).to_pylist(), piece.column(2).to_pylist())
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(who)), values], ["set_id", "x"])

    held = texts.mapInArrow(sets, "set_id bigint, x array<bigint>")
    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("x").alias("xa")), "a").join(held.select(F.col("set_id").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    scored = both.select("a", "b", (common / (F.size("xa") + F.size("xb") - common)).alias("similarity"))
    return scored.where(F.col("similarity") >= t - 1e-12)


def near_duplicate_pairs(df: DataFrame, t: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """row_id_a < row_id_b: each pair of rows at similarity `t` or more, pairs of equal texts too.

    df has row_id, text and metadata.Title. A row's words are those of Title (nothing
    if null), then text; rows whose text is null or has fewer than
    `least_words` words are left out, so an empty table gives no rows. A
    row_id that comes twice with the same text makes no pair with itself.
    """
    members, sets = similar_sets(df, t, shingle, least_words)
    m = lambda s: members.select(F.col("row_id").alias(f"row_{s}"), F.col("set_id").alias(s))
    across = sets.select("a", "b").join(m("a"), "a").join(m("b"), "b").select("row_a", "row_b")
    same = members.join(members.groupBy("set_id").count().where("count > 1"), "set_id")
    left, right = same.select("set_id", F.col("row_id").alias("row_a")), same.select("set_id", F.col("row_id").alias("row_b"))
    equal = left.join(right, "set_id").where("row_a < row_b").select("row_a", "row_b")
    both = across.unionByName(equal).where("row_a <> row_b")
    return both.select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of a graph of edges (a, b), by alternating large and small stars.

    Each round hangs every node below the smallest node it knows; the number of
    rounds grows with the logarithm of the graph's size. Each round is written
    out, and only its row count and a checksum come to the driver.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "neardup-edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last = now
        now = stage(small, "neardup-stars")
        unstage(last)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def near_duplicate_groups(df: DataFrame, t: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """row_id, group_id (the smallest row_id of its group), copies, links: one row for each row of df.

    Rows linked by a chain of pairs are one group; copies counts the rows with
    the same set of shingles, links the other sets it is similar to. A row that
    takes no part (null or short text) or has no partner is a group by itself.
    """
    members, sets = similar_sets(df, t, shingle, least_words)
    sets = stage(sets, "neardup-similar")
    parts = components(sets).withColumnRenamed("node", "set_id")
    links = sets.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    by_set = members.groupBy("set_id").agg(F.min("row_id").alias("first_row"), F.count("*").alias("copies")).join(parts, "set_id", "left").join(links, "set_id", "left")
    by_set = by_set.withColumn("component", F.coalesce("component", "set_id"))
    by_component = by_set.groupBy("component").agg(F.min("first_row").alias("group_id"))
    named = by_set.join(by_component, "component").select("set_id", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id")).where(F.col("row_id").isNotNull())
    out = rows.join(members, "row_id", "left").join(named, "set_id", "left")
    return out.select("row_id", F.coalesce("group_id", "row_id").alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
