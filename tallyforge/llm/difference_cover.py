"""Repeated windows by a distributed difference-cover algorithm: sampled triples, names, merge, neighbours.

Places are sampled by the difference cover {1, 2} mod 3. Letters are runs of 24 bytes, each one 64-bit number (their
order is that of the numbers, which is as good as any: equal prefixes stand side by side).

1. Sampled triples of letters (56 bytes) are sorted and named; names that stand alone go, and their places with them.
2. The same again on the string of names: triples of names (140 bytes) are sorted and named.
3. Merge: any two places have a shift of 0, 1 or 2 after which both are sampled. So each place enters the sorted list of
   each of its two shifts by the bytes before the first name, two names and the bytes behind them: `WIDTH` bytes in all.
4. Neighbours in a list that agree in all of these are places of a repeated window.

A triple, or an entry of a list, is sorted by one 64-bit number made of its parts. Pieces lie in units of a MB. A unit
sends its different numbers, in order, to the ranges of numbers they fall into, where they are sorted among those of all
units and answered by their names; places stay in the unit. So a number that very many places share is one of each unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, mix64, release, rolling, save, slices

WIDTH = 200
_LETTER, _APART = 24, 16
_FIRST = 2 * _APART + _LETTER
_STEP = 42
_SECOND = 2 * _STEP + _FIRST
#: Distance of the second name from the first, by shift: the last multiple of 3 that keeps it inside the window.
_NEXT = (60, 57, 57)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a unit, and numbers that a range has from one unit to all.
_UNIT_BYTES = 1 << 20
_RANGE = 2_000_000


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes, then all second ones, compressed: in order, the high ones hardly take room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(packed: bytes, kind) -> np.ndarray:
    data = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _joined(*parts: np.ndarray) -> np.ndarray:
    """One number of several, in their order."""
    out = mix64(parts[0])
    for x in parts[1:]:
        out = mix64(out * _MULTIPLIER + x)
    return out


class _Unit:
    """Some pieces one after the other; places are those in their joined bytes."""

    def __init__(self, about: bytes, data: bytes):
        self.rid, self.lo, self.n, self.begin, size = np.frombuffer(about, dtype=np.int64).reshape(5, -1)
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        self.start = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(self.bytes), dtype=np.int32)
        #: Of each place: where it is in its text, and how many bytes its piece has from there.
        self.at = place + (self.begin - self.start).astype(np.int32)[piece]
        self.room = (self.start + size).astype(np.int32)[piece] - place
        self.own = (self.at >= self.lo.astype(np.int32)[piece]) & (self.at < (self.lo + self.n).astype(np.int32)[piece])
        self.piece = piece

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and the numbers of their triples of letters."""
        place = np.flatnonzero((self.at % 3 > 0) & (self.room >= _FIRST))
        roll = rolling()
        letters = roll.all(roll.prefix(self.bytes), _LETTER) if len(place) else np.zeros(0, dtype=np.uint64)
        return place, _joined(letters[place], letters[place + _APART], letters[place + 2 * _APART])

    def triples_of_names(self, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a name, to whose distances names stand too, and the numbers of these three."""
        of = self._by_place(place, name)
        place = place[(name > 0) & (self.room[place] >= _SECOND)]
        place = place[(of[place + _STEP] > 0) & (of[place + 2 * _STEP] > 0)]
        return place, _joined(of[place], of[place + _STEP], of[place + 2 * _STEP])

    def merge_lists(self, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows by the shift to a sampled place: places, and the numbers of list, bytes that names leave out, and names."""
        of, places, numbers = self._by_place(place, name), [], []
        for shift, distance in enumerate(_NEXT):
            at = np.flatnonzero(self.own & (self.room >= WIDTH))
            at = at[(of[at + shift] > 0) & (of[at + shift + distance] > 0)]
            told = np.full(len(at), shift, dtype=np.uint64)
            for k in (*range(shift), *range(shift + distance + _SECOND, WIDTH)):
                told = (told << np.uint64(8)) | self.bytes[at + k].astype(np.uint64)
            places.append(at.astype(np.int32))
            numbers.append(_joined(told, of[at + shift], of[at + shift + distance]))
        return np.concatenate(places), np.concatenate(numbers)

    def _by_place(self, place: np.ndarray, name: np.ndarray) -> np.ndarray:
        of = np.zeros(len(self.bytes), dtype=np.uint64)
        of[place] = name
        return of

    def spans(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rid, s, e) of runs of neighbouring windows at these places."""
        place = np.unique(place)
        new = np.append(True, (place[1:] != place[:-1] + 1) | (self.piece[place[1:]] != self.piece[place[:-1]]))[: len(place)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))[: len(first)] - 1
        return self.rid[self.piece[place[first]]], self.at[place[first]], self.at[place[last]] + WIDTH


def _units(pieces: DataFrame) -> DataFrame:
    """(unit, about, bytes, places) of pieces (rid, lo, n, begin, bytes); places: how many bytes."""
    schema = pa.schema([("unit", pa.int64()), ("about", pa.binary()), ("bytes", pa.binary()), ("places", pa.int64())])

    def scan(batches):
        made, held, size = TaskContext.get().partitionId() << 32, [], 0

        def unit():
            about = np.array([[*x[:4], len(x[4])] for x in held], dtype=np.int64).T.tobytes()
            row = [made, about, b"".join(x[4] for x in held), size]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in slices(batches, 64):
            for row in zip(*(batch.column(c).to_pylist() for c in ("rid", "lo", "n", "begin", "bytes")), strict=True):
                held.append(row)
                size += len(row[4])
                if size >= _UNIT_BYTES:
                    yield unit()
                    made, held, size = made + 1, [], 0
        if held:
            yield unit()

    return pieces.mapInArrow(scan, "unit long, about binary, bytes binary, places long")


def _different(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different numbers in order, whether each is there more than once, and the order with the place of each in it."""
    order = np.argsort(numbers)
    ordered = numbers[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    first = np.flatnonzero(new)
    return ordered[first], np.diff(np.append(first, len(ordered))) > 1, order, np.cumsum(new) - 1


def _answered(numbers: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """For each number the answer to it; answers are those to the different numbers in order."""
    _, _, order, at = _different(numbers)
    out = np.empty(len(numbers), dtype=answers.dtype)
    out[order] = answers[at]
    return out


def _names(asked: list[dict]) -> np.ndarray:
    """Names from the ranges' answers, which come in order of the ranges: they rise over all ranges, and 0 is none."""
    out = []
    for x in asked:
        rank = _numbers(x["names"], np.uint32).astype(np.uint64)
        out.append(np.where(rank > 0, (np.uint64(x["range"]) << np.uint64(32)) + rank, np.uint64(0)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _numbers_of(unit: _Unit, first, second):
    """Places and numbers of the round that the answers so far lead to."""
    place, numbers = unit.triples()
    for answers, following in ((first, unit.triples_of_names), (second, unit.merge_lists)):
        if answers is None:
            break
        place, numbers = following(place, _answered(numbers, _names(answers)))
    return place, numbers


def _ask(units: DataFrame, answers: list[DataFrame], ranges: int, only_whether: bool = False) -> DataFrame:
    """(unit, asked array<struct<range, names>>): the names of each unit's different numbers of this round."""
    edges = np.array([(r << 64) // ranges for r in range(ranges)], dtype=np.uint64)
    schema = pa.schema([("range", pa.int32()), ("unit", pa.int64()), ("numbers", pa.binary()), ("many", pa.binary())])
    rounds = len(answers)

    def deal(batches):
        for unit, row in _opened(batches, rounds):
            found, many, _, _ = _different(_numbers_of(unit, *row["answers"])[1])
            cuts = np.append(np.searchsorted(found, edges), len(found)).tolist()
            for at in range(0, ranges, 64):
                own = [(r, slice(cuts[r], cuts[r + 1])) for r in range(at, min(at + 64, ranges)) if cuts[r + 1] > cuts[r]]
                if own:
                    cols = [[r for r, _ in own], [row["unit"]] * len(own), [_packed(found[x]) for _, x in own], [np.packbits(many[x]).tobytes() for _, x in own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    def name(table: pa.Table) -> pa.Table:
        asked = [_numbers(x, np.uint64) for x in table.column("numbers").to_pylist()]
        times = [1 + np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(x)) for m, x in zip(table.column("many").to_pylist(), asked, strict=True)]
        numbers, times = np.concatenate(asked), np.concatenate(times)
        order = np.argsort(numbers)
        numbers, times = numbers[order], times[order]
        first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        kept = (np.diff(np.append(first, len(numbers))) > 1) | (times[first] > 1)
        names = np.where(kept, 1 if only_whether else np.cumsum(kept), 0).astype(np.uint32)
        found = numbers[first]
        replies = [_packed(names[np.searchsorted(found, x)]) for x in asked]
        return pa.table({"unit": table.column("unit"), "range": table.column("range"), "names": pa.array(replies, pa.binary())})

    dealt = _with(units, answers).mapInArrow(deal, "range int, unit long, numbers binary, many binary")
    named = dealt.groupBy("range").applyInArrow(name, "unit long, range int, names binary")
    return named.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("range", "names"))).alias("asked"))


def _with(units: DataFrame, answers: list[DataFrame]) -> DataFrame:
    out = units.select("unit", "about", "bytes")
    for k, x in enumerate(answers):
        out = out.join(x.withColumnRenamed("asked", f"asked{k}"), "unit")
    return out


def _opened(batches, rounds: int):
    """Units with their number and answers; the first two rounds' lead to numbers, None where there is none yet."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            asked = [row[f"asked{i}"] for i in range(rounds)]
            yield _Unit(row["about"], row["bytes"]), {"unit": row["unit"], "answers": [*asked, None, None][:2], "last": asked[-1] if asked else None}


def _spans(units: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """(rid, s, e) of runs of neighbouring windows."""
    rounds = len(answers)

    def scan(batches):
        for unit, row in _opened(batches, rounds):
            place, numbers = _numbers_of(unit, *row["answers"])
            rid, s, e = unit.spans(place[_answered(numbers, _names(row["last"])) > 0])
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["rid", "s", "e"])

    return _with(units, answers).mapInArrow(scan, "rid long, s int, e int")


def repeated_windows(pieces: DataFrame) -> DataFrame:
    """Spans (rid, s, e) of windows of `WIDTH` bytes that stand at two places of the pieces or more.

    pieces (rid, lo, n, begin, bytes): a place of a text lies in one piece; its bytes reach at least WIDTH - 1 bytes
    behind the last place, or to the text's end. A saved table of spans is returned; no pieces give none.
    """
    spark = pieces.sparkSession
    units = save(_units(pieces), "units")
    release(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(units.agg(F.sum("places")).first()[0] or 0) // _RANGE))
    answers: list[DataFrame] = []
    for name in ("names-56", "names-140", "merged"):
        # a unit without an answer has no numbers left
        answers.append(save(_ask(units, answers, ranges, only_whether=name == "merged"), name))
        release(spark)
    spans = save(_spans(units, answers), "windows-repeated")
    drop(units, *answers)
    release(spark)
    return spans
