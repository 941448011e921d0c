"""Benchmark decontamination by template windows.

Words are canonicalised: those with digits become <number>, units <unit>,
capitalised words (not those all in capitals) inside a sentence <name>; the rest is lower-cased and
stripped of outer punctuation. Windows of five template words of the benchmark
are hash-joined with those of the documents. A document is taken to hold an
item when it holds 80 % or more of the item's distinct windows and the slots
are consistent: where an item says one thing twice (a name, a number), so does
the document. So an item with other numbers and names is caught.
Slots are judged by occurrence: each shift between places in the item and in the
document gives every slot of the item the word of the document that stands
there, by the window that lies nearest, and the most consistent shift counts, so
copies and variants in one document do not spoil one another. Only slots that
the item repeats can disagree; 80 % of their repeats must agree. A document that
holds 80 % of the item's windows word for word is taken without the slot test.

A window needs ``LITERAL`` plain words to count as a template; where an item has
too few such windows (lists of names and numbers, say), its windows run on until
they hold ``LITERAL`` plain words. Items most of whose windows never hold so
many plain words, and items of under five words (whole, as they stand), are
found word for word only. Items that differ in their slots alone are one class,
joined and judged once; a row names its smallest item and their number
(``item_classes`` lists them), so variants of one question never multiply rows.

Null texts and items without words hold nothing; very long texts are windowed
whole; repeated items and documents give a row each pair of document and class;
ties don't arise; an empty table on either side gives no rows; other columns are
passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, SPACE, flat, mix, powers, settle, slices, span_hashes, window_hashes, windows, word_spans

WINDOW, CONTAINED, LITERAL, CONSISTENT, WIDE = 5, 0.8, 3, 0.8, 10
#: Benchmark windows up to which their hashes go to every worker (8 bytes each) to thin out the join's other side.
MOST_BROADCAST = 1 << 21
#: Ids of documents that hold an item up to which they go to every worker (8 bytes each) to drop those documents.
MOST_IDS = 1 << 21

#: Units that become a placeholder (fixed values).
UNITS = ["kg", "g", "mg", "km", "m", "cm", "mm", "mile", "miles", "inch", "inches", "feet", "foot", "yard", "yards", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "litre", "litres", "liter", "liters", "ml", "gallon", "gallons", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degrees", "mph", "kmh"]

PUNCTUATION, DIGIT, UPPER, STOP = (np.zeros(256, bool) for _ in range(4))
PUNCTUATION[list(b".,;:!?\"'()[]{}<>|*#$%&_-+=/\\")] = True
DIGIT[48:58] = True
UPPER[65:91] = True
STOP[list(b".!?:")] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Which code points of two bytes in UTF-8 are capitals.
WIDE_CAPITALS = np.array([chr(c).isupper() and c >= 0x80 for c in range(0x800)]).astype(np.int64)
NUMBER, UNIT, NAME = (np.uint64(x) for x in (11, 22, 33))


def _wide_capital(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 where a capital letter of two bytes stands (Latin-1 and its extension, Greek, Cyrillic), by its case as Unicode has it."""
    code = ((data[at].astype(np.int64) & 0x1F) << 6) | (data[np.minimum(at + 1, len(data) - 1)] & 0x3F)
    return ((data[at] & 0xE0) == 0xC0).astype(np.int64) * WIDE_CAPITALS[code]


def _unit_hashes() -> np.ndarray:
    words = [u.encode() for u in UNITS]
    ends = np.cumsum(list(map(len, words)))
    return np.sort(span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - list(map(len, words)), ends))


def template(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each word: its row, the hash of its plain form, and of its template form; and whether it is plain."""
    starts, ends, rows = word_spans(data, offsets, SPACE)
    low = LOWERED[data]
    a, b = starts.copy(), ends.copy()
    # Outer punctuation goes: from the first other byte at or after the start to the last one before the end.
    inner = np.append(np.where(PUNCTUATION[data], len(data), np.arange(len(data))), len(data))
    a = np.minimum(np.minimum.accumulate(inner[::-1])[::-1][a], ends)
    b = np.maximum(np.maximum.accumulate(np.append(0, np.where(PUNCTUATION[data], 0, np.arange(1, len(data) + 1))))[b], starts)
    bare = a >= b
    a, b = np.where(bare, starts, a), np.where(bare, ends, b)
    plain = span_hashes(low, a, b)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(DIGIT[data], out=digits[1:])
    form = plain.copy()
    if len(starts):
        begins = np.concatenate([[True], (rows[1:] != rows[:-1]) | STOP[data[ends[:-1] - 1]]])
        size = np.where(UPPER[data[a]], 1, 2 * _wide_capital(data, a))
        then = np.minimum(a + size, len(data) - 1)
        name = (size > 0) & ~begins & ~bare & (b - a > size) & ~UPPER[data[then]] & (_wide_capital(data, then) == 0)
        form[name] = NAME
        units = _unit_hashes()
        form[units[np.minimum(np.searchsorted(units, plain), len(units) - 1)] == plain] = UNIT
        form[digits[b] > digits[a]] = NUMBER
    return {"rows": rows, "plain": plain, "form": form, "literal": form == plain}


def template_windows(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, template hash (zero: not a template) and word-for-word hash of each window."""
    first = windows(t["rows"], WINDOW)
    literal = np.zeros(len(first), np.int64)
    for k in range(WINDOW):
        literal += t["literal"][first + k]
    form = mix(window_hashes(t["form"], first, WINDOW) | np.uint64(1))
    return first, np.where(literal >= LITERAL, form, np.uint64(0)), window_hashes(t["plain"], first, WINDOW)


def long_windows(t: dict[str, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and hash of the windows from ``first`` that run on until they hold LITERAL plain words; those that leave their row go."""
    literal = np.flatnonzero(t["literal"])
    nth = np.searchsorted(literal, first) + LITERAL - 1
    first, nth = first[nth < len(literal)], nth[nth < len(literal)]
    ends = np.maximum(literal[nth] + 1, first + WINDOW) if len(nth) else nth
    inside = t["rows"][ends - 1] == t["rows"][first] if len(nth) else np.zeros(0, bool)
    first, ends = first[inside], ends[inside]
    n = len(t["form"])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(t["form"] + np.uint64(1)) * powers(BASE, n)[:n], out=total[1:])
    return first, ends, mix((total[ends] - total[first]) * powers(BASE_INVERSE, n)[first] + (ends - first).astype(np.uint64))


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


#: How an item is found: by templates of WINDOW words, word for word, by templates that run on, by WIDE forms in order.
TEMPLATES, WORDS, LONG, FORMS = 0, 1, 2, 3
ITEM_DDL = "item_id long, kind long, way int, h long, place int, width int, n_windows int, slots binary"


def short_windows(t: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word-for-word hash of each run of ``size`` words, under WINDOW."""
    first = windows(t["rows"], size)
    return first, mix(window_hashes(t["plain"], first, size) + np.uint64(size))


def wide_windows(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of WIDE forms."""
    first = windows(t["rows"], WIDE)
    return first, mix(window_hashes(t["form"], first, WIDE) + np.uint64(WIDE))


def _tells_enough(literal: np.ndarray, slots: np.ndarray) -> bool:
    """Whether an item's forms are its own: a plain word, and LITERAL plain words and repeats of slots in all."""
    said = slots[slots != 0]
    return literal.any() and literal.sum() + len(said) - len(np.unique(said)) >= LITERAL


def item_windows(items: DataFrame) -> DataFrame:
    """A row for each window of each item and way: its class, hash and place, the item's distinct windows, its slots (zero: a plain word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                t = template(data, offsets)
                slots = np.where(t["literal"], np.uint64(0), t["plain"])
                first, form, plain = template_windows(t)
                wide_first, wide_h = wide_windows(t)
                ids, out = part.column("item_id").to_pylist(), []
                begins = np.searchsorted(t["rows"], np.arange(part.num_rows + 1))
                for r, (low, high) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                    if 0 < high - low < WINDOW:
                        at, h = short_windows({"rows": t["rows"][low:high], "plain": t["plain"][low:high]}, int(high - low))
                        ways = [(WORDS, at + low, at + high, h)]
                    else:
                        own = np.flatnonzero((first >= low) & (first < high))
                        templates = own[form[own] != 0]
                        ways = [(WORDS, first[own], first[own] + WINDOW, plain[own])]
                        if 2 * len(templates) >= len(own):
                            ways.append((TEMPLATES, first[templates], first[templates] + WINDOW, form[templates]))
                        else:
                            at, ends, h = long_windows(t, first[own[form[own] == 0]])
                            at, ends, h = (np.concatenate(x) for x in zip((first[templates], first[templates] + WINDOW, form[templates]), (at, ends, h), strict=True))
                            if 2 * len(at) >= len(own):
                                ways.append((LONG, at, ends, h))
                            elif _tells_enough(t["literal"][low:high], slots[low:high]):
                                mine = (wide_first >= low) & (wide_first < high)
                                ways.append((FORMS, wide_first[mine], wide_first[mine] + WIDE, wide_h[mine]))
                    pattern = np.unique(slots[low:high], return_inverse=True)[1]
                    _, place_of_first = np.unique(pattern, return_index=True)
                    pattern = place_of_first[pattern] if len(pattern) else pattern  # the same for items that differ in their slots' words only
                    for way, at, ends, h in ways:
                        if len(h):
                            told = b"".join(map(_pack, (h, at - low, ends - at, pattern if way != WORDS else np.zeros(0, np.int64))))
                            kind = int.from_bytes(hashlib.blake2b(told, digest_size=8, key=bytes([way])).digest(), "little", signed=True)
                            n = len(np.unique(h))
                            out += [(ids[r], kind, way, int(x), int(a - low), int(b - a), n, _pack(slots[a:b])) for a, b, x in zip(at, ends, h.view(np.int64), strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3, pa.binary()], strict=True)], ["item_id", "kind", "way", "h", "place", "width", "n_windows", "slots"])

    return items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ITEM_DDL)


def item_classes(items: DataFrame) -> DataFrame:
    """item_id and the smallest item of its class, for each way: items of one class differ in their slots' words only."""
    kinds = item_windows(items).select("item_id", "kind", "way").distinct()
    return kinds.join(kinds.groupBy("kind").agg(F.min("item_id").alias("first_item")), "kind").select("item_id", "way", "first_item")


#: Shifts that are judged at once.
SHIFTS = 1024


def best_occurrence(h: np.ndarray, place: np.ndarray, slots: np.ndarray, doc_h: np.ndarray, doc_place: np.ndarray, doc_words: np.ndarray) -> float:
    """The share of an item's repeated slots that agree in the best occurrence; 1 where the item repeats none.

    ``slots`` are the item's windows with zeros for plain words.
    """
    order = np.lexsort([doc_place, doc_h])
    doc_h, doc_place, doc_words = doc_h[order], doc_place[order], doc_words[order]
    low, high = np.searchsorted(doc_h, h, side="left"), np.searchsorted(doc_h, h, side="right")
    there = np.flatnonzero(high > low)
    low, high, place, slots = low[there], high[there], place[there], slots[there]
    # Which window covers the slot at a position with its c-th word; -1: none.
    position = place[:, None] + np.arange(slots.shape[1])
    known, index = np.unique(position[slots != 0], return_index=True)
    said = slots[slots != 0][index]
    cover = np.full((slots.shape[1], len(known)), -1)
    for k, c in zip(*np.nonzero(slots), strict=True):
        cover[c, np.searchsorted(known, position[k, c])] = k
    _, slot, times = np.unique(said, return_inverse=True, return_counts=True)
    again = times[slot] > 1
    if not again.any():
        return 1.0
    cover, slot = cover[:, again], slot[again]
    repeats = int((times[times > 1] - 1).sum())
    _, value = np.unique(doc_words, return_inverse=True)
    value = value.reshape(doc_words.shape)
    shifts = np.unique(np.concatenate([doc_place[a:b] - p for p, a, b in zip(place, low, high, strict=True)]))
    n_values, n_slots, best = int(value.max()) + 1, int(slot.max()) + 1, 0.0
    for start in range(0, len(shifts), SHIFTS):
        some = shifts[start : start + SHIFTS]
        near, away = np.empty((len(some), len(place)), np.int64), np.empty((len(some), len(place)), np.int64)
        for k, (p, a, b) in enumerate(zip(place, low, high, strict=True)):
            after = np.clip(np.searchsorted(doc_place[a:b], some + p), 0, b - a - 1)
            before = np.maximum(after - 1, 0)
            gap_before, gap_after = np.abs(doc_place[a + before] - p - some), np.abs(doc_place[a + after] - p - some)
            near[:, k], away[:, k] = a + np.where(gap_before <= gap_after, before, after), np.minimum(gap_before, gap_after)
        seen, least = np.zeros((len(some), len(slot)), np.int64), np.full((len(some), len(slot)), np.iinfo(np.int64).max)
        for c, windows_of in enumerate(cover):
            at = np.flatnonzero(windows_of >= 0)
            if len(at):
                k = windows_of[at]
                closer = away[:, k] < least[:, at]
                seen[:, at] = np.where(closer, value[near[:, k], c], seen[:, at])
                least[:, at] = np.where(closer, away[:, k], least[:, at])
        keys = (np.arange(len(some))[:, None] * n_slots + slot) * n_values + seen
        pair, count = np.unique(keys, return_counts=True)
        first = np.flatnonzero(np.diff(pair // n_values, prepend=-1))
        most = np.maximum.reduceat(count, first) - 1
        best = max(best, float(np.bincount(pair[first] // n_values // n_slots, weights=most).max()) / repeats)
        if best == 1:
            break
    return best


def find_items(docs: DataFrame, items: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_items, n_windows, n_matched, consistency of each document that holds an item of a class; item_id is the class's smallest."""
    bench = settle(item_windows(items))
    members = bench.select("kind", "item_id").distinct().groupBy("kind").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    classes = bench.groupBy("kind", "way", "n_windows", "h", "place").agg(F.first("slots").alias("slots"))  # the same but for the slots' words
    short = sorted(r[0] for r in bench.where(F.col("width") < WINDOW).select("width").distinct().collect())  # four lengths at most
    in_order = not bench.where(F.col("way") == FORMS).isEmpty()
    hashes = None
    if bench.count() <= most_broadcast:  # the size is checked; beyond it every window goes into the join
        hashes = np.unique(np.array([r[0] for r in bench.select("h").distinct().collect()], np.int64).view(np.uint64))
        near = np.zeros(1 << 20, bool)
        near[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                t = template(data, offsets)
                first, form, plain = template_windows(t)
                templates = form != 0
                sets = [(first[templates], first[templates] + WINDOW, form[templates]), (first, first + WINDOW, plain), long_windows(t, first[~templates])]
                sets += [(at, at + size, h) for size in short for at, h in [short_windows(t, size)]]
                sets += [(at, at + WIDE, h) for at, h in [wide_windows(t)] if in_order]
                for at, ends, h in sets:
                    if hashes is not None:
                        use = np.flatnonzero(near[(h >> np.uint64(44)).astype(np.int64)])
                        use = use[np.isin(h[use], hashes)] if len(hashes) else use[:0]
                        at, ends, h = at[use], ends[use], h[use]
                    row = t["rows"][at] if len(at) else at
                    copy = span_hashes(data, offsets[:-1], offsets[1:])[row].view(np.int64)
                    cols = [part.column("doc_id").take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(copy), pa.array(at - np.searchsorted(t["rows"], row), pa.int64()), pa.array([_pack(t["plain"][a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "copy", "place", "words"])

    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h long, copy long, place long, words binary")
    # Repeated rows of a document are counted once; ``copy`` tells different texts of one doc_id apart.
    pairs = settle(found.distinct()).join(classes.select("kind", "way", "n_windows", "h").distinct(), "h")
    counted = pairs.groupBy("doc_id", "kind", "way", "n_windows").agg(F.count_distinct("h").alias("n_matched"))
    enough = counted.where(F.col("n_matched") >= F.col("n_windows") * F.when(F.col("way") == FORMS, 1.0).otherwise(CONTAINED))

    def judge(part: pa.Table) -> pa.Table:
        of_item = part.column("copy").is_null().to_numpy()
        h, place = part.column("h").to_numpy(), part.column("place").to_numpy()
        packed = part.column("words").to_pylist()
        width = max(map(len, packed))  # windows that run on are longer; the ends of the others stay empty
        words = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in packed), np.uint64).reshape(-1, width // 8)
        copy = np.unique(part.column("copy").to_numpy(zero_copy_only=False)[~of_item], return_inverse=True)[1]
        share = best_occurrence(h[of_item], place[of_item], words[of_item], h[~of_item], place[~of_item] + (copy.astype(np.int64) << 40), words[~of_item])
        return part.select(["doc_id", "kind", "way", "n_windows", "n_matched"])[:1].append_column("consistency", pa.array([share]))

    keys = ["doc_id", "kind", "way", "n_windows", "n_matched"]
    asked = enough.where(F.col("way") != WORDS).select(F.col("doc_id").alias("d"), F.col("kind").alias("k"), "n_matched")
    mine = pairs.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("kind") == F.col("k"))).select(*keys, "h", "copy", "place", "words")
    theirs = enough.where(F.col("way") != WORDS).join(classes, ["kind", "way", "n_windows"]).withColumn("copy", F.lit(None).cast("long")).withColumn("place", F.col("place").cast("long")).withColumnRenamed("slots", "words")
    judged = mine.unionByName(theirs.select(mine.columns)).groupBy("doc_id", "kind", "way", "n_windows").applyInArrow(judge, "doc_id long, kind long, way int, n_windows int, n_matched long, consistency double")
    held = judged.where(F.col("consistency") >= CONSISTENT).unionByName(enough.where(F.col("way") == WORDS).withColumn("consistency", F.lit(1.0)).select(*keys, "consistency"))
    # An item found both ways gives one row, the word-for-word one.
    best = F.max(F.struct((F.col("way") == WORDS).alias("exact"), "n_windows", "n_matched", "consistency", "n_items")).alias("r")
    return held.join(members, "kind").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "r.n_items", "r.n_windows", "r.n_matched", "r.consistency")


def drop_contaminated(docs: DataFrame, items: DataFrame, most_broadcast: int = MOST_IDS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    bad = settle(find_items(docs, items).select("doc_id").distinct())
    names = [f"c_{i}" for i in range(len(docs.columns))]  # columns of docs may have any names
    mine = docs.toDF(*names)
    key = F.col(names[docs.columns.index("doc_id")])
    if bad.count() <= most_broadcast:  # the size is checked: texts stay where they are
        return mine.join(F.broadcast(bad), key.eqNullSafe(F.col("doc_id")), "left_anti").toDF(*docs.columns)
    # Rows without an id would all meet in one task: one answer serves them all.
    nameless = mine.where(key.isNull()).where(F.lit(bad.where("doc_id is null").isEmpty()))
    return mine.where(key.isNotNull()).join(bad, key == F.col("doc_id"), "left_anti").unionByName(nameless).toDF(*docs.columns)
