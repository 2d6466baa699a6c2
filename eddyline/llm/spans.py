"""Exact spans of at least a given length that stand in more than one document.

Chunks are content-defined: a gear rolling hash over the last 32 characters is cut where it is least among 109 consecutive positions. Cuts depend on nothing but the text around
them, so they move with insertions, and any 250 equal characters hold at least one whole chunk (with the 32 characters that made its right cut) in either document. Chunks are
deduplicated by digest; what follows only narrows down to exact positions, and every step asks the same question, "which digests stand in more than one document?":

1. chunks: a window of 250 characters can only be shared if all chunks inside it are;
2. cores and stretches: consecutive windows with the same first and last chunk form a group. The chunks they have in common (the core) must be shared; if all the text of the group
   (the stretch) is shared, so is each of its windows;
3. open cores: where the core is shared but the stretch is not, as at the ends of a shared span, the group is open. All groups with the core of an open one are told;
4. windows: these groups ask for each of their windows.

Digests travel as packed arrays per (bucket of digests, pack of documents), each digest at most once a pack, so a digest that a third of all documents hold costs one entry a pack.
Texts are kept once as compressed packs in the checkpoint folder, partitioned by pack; only digests are shuffled afterwards. Documents over part_chars are handled in parts
that overlap by 249 characters. From step 3 on only documents in which something may be shared are looked at again.

Digests come from two 64-bit polynomial hashes. Those that decide the result, of stretches and windows, have 80 bits, so among 10^12 of them less than one pair of different texts is
expected to be taken for the same; the others only narrow down and have 48 bits.

Null ids and texts are left out; texts shorter than the span have no spans. Rows that repeat an id count as the same document. Ids that are not whole numbers go by their 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from eddyline.session import cut_lineage

GEAR = 32
BUCKET_BYTES, TOGETHER = 16 << 20, 4_000_000
_U = np.uint64
_MANY = 65535
_CHUNK, _CORE, _STRETCH, _WINDOW, _OPEN = range(5)
_PLAIN, _CHECKED, _ALIVE = range(3)  # kinds of packed arrays
_PART = ~_U(0xFFFF)  # the part of a plain digest that is used
_MOST_BUCKETS = 16_384
_SEEDS = tuple(_U(x) for x in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 multipliers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2^64; those of the largest block so far are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point below 2^16 the gear value and two 64-bit values; others are mixed when met."""
    x = np.arange(1 << 16, dtype=np.uint64)
    return _mix(x + _SEEDS[2]).astype(np.uint32), _mix(x + _SEEDS[0]), _mix(x + _SEEDS[1])


class Block:
    """Some documents, as one array of code points, with the hashes and cuts of all of them."""

    def __init__(self, texts: list[str], span: int) -> None:
        self.span = span
        lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(points)
        gear, one, two = _letters()
        low = np.minimum(points, (1 << 16) - 1)
        g, values = gear[low], [one[low], two[low]]
        far = np.flatnonzero(points >= 1 << 16)
        if len(far):
            x = points[far].astype(np.uint64)
            g[far] = _mix(x + _SEEDS[2]).astype(np.uint32)
            values[0][far], values[1][far] = _mix(x + _SEEDS[0]), _mix(x + _SEEDS[1])
        size = 1 << max(16, int(n).bit_length())
        self.prefix = []
        for base, value in zip(_BASES, values):
            value *= _powers(base, size)[0][:n]
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)]))
        self.down = [_powers(base, size)[1] for base in _BASES]
        self._cut(g)

    def digest(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        return self.checked(start, end, kind)[0]

    def checked(self, start: np.ndarray, end: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests, and 16 further bits of the same hashes."""
        first, second = ((p[end] - p[start]) * d[start] for p, d in zip(self.prefix, self.down))
        further = (_mix(second + _U(kind)) + first * _SEEDS[1]) >> _U(48)
        return _mix(_mix(first + _U(kind)) ^ (second * _SEEDS[3])), further.astype(np.uint16)

    def _cut(self, g: np.ndarray) -> None:
        """Runs of positions x with the same place of the least gear hash among those starting at x .. x + reach - 1 (the leftmost of equals); cuts: the places that lie in one document."""
        n, span = self.n, self.span
        self.reach = reach = (span - GEAR + 1) // 2
        h, width = g, 1
        while width < GEAR:  # h[p] covers the characters p .. p + width - 1, the last one unshifted
            longer = h[: len(h) - width] << np.uint32(width)
            longer += h[width:]
            h, width = longer, 2 * width
        key = h.astype(np.uint64)
        key <<= _U(32)
        key |= np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if width < reach and len(key):
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
        least = key.astype(np.uint32)  # never falls from one position to the next
        self.run_starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1]) if len(least) else np.zeros(0, np.int64)
        self.run_least = least[self.run_starts].astype(np.int64)
        # a run counts if one of its positions has its whole reach in the document: its first one, or the start of the next document
        doc = self.doc(self.run_starts)
        fits = self.offsets[doc + 1] - self.run_starts >= reach + GEAR - 1
        run_ends = np.append(self.run_starts[1:], len(least)) if len(least) else self.run_starts
        fits |= (self.offsets[doc + 1] < run_ends) & (self.offsets[np.minimum(doc + 2, len(self.offsets) - 1)] - self.offsets[doc + 1] >= reach + GEAR - 1)
        self.cuts = self.run_least[fits]
        self.cut_doc = self.doc(self.cuts)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, "right") - 1

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Digest and document of the chunk behind each cut but the last of its document."""
        whole = np.flatnonzero(self.cut_doc[1:] == self.cut_doc[:-1])
        return self.digest(self.cuts[whole], self.cuts[whole + 1] + GEAR, _CHUNK), whole

    def groups(self, shared: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Groups of consecutive windows with the same first and last cut and only shared chunks between: first and last window, core and stretch digest with check."""
        digests, whole = self.chunks()
        bad = np.ones(len(self.cuts) + 1, np.int32)
        bad[whole] = ~shared(digests)
        before = np.concatenate([[0], np.cumsum(bad)])
        shift = self.span - GEAR + 1 - self.reach
        begins, ends = self.offsets[:-1], self.offsets[1:] - self.span + 1  # of the windows of each document
        edges = np.sort(np.concatenate([self.run_starts, self.run_starts - shift, begins, ends]), kind="stable")  # four sorted parts
        edges = edges[(edges >= 0) & (edges < self.n) & np.append(edges[1:] != edges[:-1], True)]
        low, high = edges, np.append(edges[1:], self.n) - 1
        inside = low < ends[self.doc(low)]
        low, high = low[inside], high[inside]
        first, last = (self.run_least[np.searchsorted(self.run_starts, x, "right") - 1] for x in (low, low + shift))
        first, last = np.searchsorted(self.cuts, first), np.searchsorted(self.cuts, last)
        good = before[last] == before[first]
        low, high, first, last = low[good], high[good], first[good], last[good]
        core = self.digest(self.cuts[first], self.cuts[last] + GEAR, _CORE)
        return low, high, core, self.checked(low, high + self.span, _STRETCH)


def _thin(digests: np.ndarray) -> bytes:
    """The used bytes of plain digests."""
    return np.ascontiguousarray(digests.astype("<u8").view("u1").reshape(-1, 8)[:, 2:]).tobytes()


def _thick(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), "u1")
    out[:, 2:] = np.frombuffer(data, "u1", 6 * n, at).reshape(n, 6)
    return out.view("<u8").ravel()


class Known:
    """What a pack has been told: digests, digests with checks, and per blob the texts that are worth another look."""

    def __init__(self, flags: pa.Table | None) -> None:
        plain, checked, self.alive, step_of = [], [], {}, {}
        for blob in () if flags is None else flags.column("blob"):
            data = blob.as_py()
            kind, n = np.frombuffer(data, "<i8", 2)
            if kind == _PLAIN:
                plain.append(_thick(data, n, 16))
            elif kind == _CHECKED:
                checked.append((np.frombuffer(data, "<u8", n, 16), np.frombuffer(data, "<u2", n, 16 + 8 * n)))
            else:
                step, mark = np.frombuffer(data, "<i8", 2, 16)
                if step > step_of.get(int(mark), 0):
                    step_of[int(mark)], self.alive[int(mark)] = int(step), np.frombuffer(data, "<i4", n, 32)
        self.digests = np.unique(np.concatenate(plain)) if plain else np.zeros(0, np.uint64)
        pairs, checks = (np.concatenate([c[i] for c in checked]) if checked else np.zeros(0, np.uint64) for i in range(2))
        order = np.lexsort((checks, pairs))
        self.pairs, self.checks = pairs[order], checks[order]
        same = self.pairs[1:] == self.pairs[:-1]
        self.deepest = 1 + (int(np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]]))).max()) if len(self.pairs) else 0)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        if not len(self.digests):
            return np.zeros(len(asked), bool)
        asked = asked & _PART
        return self.digests[np.minimum(np.searchsorted(self.digests, asked), len(self.digests) - 1)] == asked

    def both(self, asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether digest and check are known."""
        found = np.zeros(len(asked[0]), bool)
        if len(self.pairs):
            at = np.searchsorted(self.pairs, asked[0])
            for k in range(self.deepest - 1):  # as many as share a digest, most often one
                i = np.minimum(at + k, len(self.pairs) - 1)
                found |= (self.pairs[i] == asked[0]) & (self.checks[i] == asked[1])
        return found


def _encode(ids: list[int], bases: list[int], texts: list[str]) -> bytes:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    head = np.array([ids, bases, [len(r) for r in raw]], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(ids)], "<i8").tobytes() + head.tobytes() + b"".join(raw))


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, bases, sizes = np.frombuffer(data, "<i8", 3 * n, 8).reshape(3, n)
    ends = 8 + 24 * n + np.cumsum(sizes)
    return ids, bases, [data[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends.tolist())]


def packs(documents: DataFrame, doc_id: Column, text: Column, span: int, pack_chars: int, part_chars: int, partitions: int) -> DataFrame:
    """pack, blob: the texts that are long enough, in compressed packs, written once and partitioned by pack."""
    rows = documents.select(doc_id.cast("long").alias("id"), text.alias("text")).where((F.length("text") >= span) & F.col("id").isNotNull())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bases, texts, size = [], [], [], 0

        def give() -> pa.RecordBatch:
            name = int(_mix(np.array([ids[0], bases[0]], np.int64).view(np.uint64))[0] >> _U(1)) ^ (bases[0] << 1)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_encode(ids, bases, texts)], pa.binary())], ["pack", "blob"])

        for batch in batches:
            for one, raw in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary())):
                whole = raw.as_py().decode("utf-8", "replace")
                for base in range(0, max(1, len(whole) - span + 1), part_chars):
                    part = whole[base : base + part_chars + span - 1]
                    if texts and (size + len(part) > pack_chars or len(ids) >= 60_000):
                        yield give()
                        ids, bases, texts, size = [], [], [], 0
                    ids.append(one)
                    bases.append(base)
                    texts.append(part)
                    size += len(part)
        if texts:
            yield give()

    made = rows.mapInArrow(gather, "pack long, blob binary")
    return cut_lineage(made.repartition(partitions, "pack"), keep_partitioning=True)


def _entries(pack: int, digests: np.ndarray, docs: np.ndarray, ids: np.ndarray, loud: np.ndarray | None, buckets: int, checks: np.ndarray | None = None) -> Iterator[tuple]:
    """(bucket, pack, blob) rows: sorted digests, each once, with its document or the mark that several documents of the pack have it, or that it counts as such (loud)."""
    if not len(digests):
        return
    order = np.argsort(digests, kind="stable") if checks is None else np.lexsort((checks, digests))
    digests, docs = digests[order], docs[order]
    new = digests[1:] != digests[:-1]
    if checks is not None:
        checks = checks[order]
        new |= checks[1:] != checks[:-1]
    at = np.flatnonzero(np.concatenate([[True], new]))
    named = np.unique(ids, return_inverse=True)[1].astype(np.int64)[docs]
    several = np.minimum.reduceat(named, at) != np.maximum.reduceat(named, at)
    if loud is not None:
        several |= np.logical_or.reduceat(loud[order], at)
    table = np.unique(ids)
    owner = np.where(several, _MANY, named[at]).astype("<u2")
    digests = digests[at]
    bucket = ((digests >> _U(32)) * _U(buckets)) >> _U(32)  # rising with the digest
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        present, local = np.unique(owner[part], return_inverse=True)
        real = present[present != _MANY]
        local = np.where(owner[part] == _MANY, _MANY, local).astype("<u2")
        head = np.array([_PLAIN if checks is None else _CHECKED, edges[b + 1] - edges[b], len(real)], "<i8").tobytes()
        body = _thin(digests[part]) if checks is None else digests[part].astype("<u8").tobytes() + checks[at[part]].astype("<u2").tobytes()
        yield int(b), pack, head + table[real].astype("<i8").tobytes() + body + local.tobytes()


class _Owners:
    """Document ids of the entries of a blob, from their places in its table; taken by slices."""

    def __init__(self, table: np.ndarray, local: np.ndarray) -> None:
        self.table, self.local = np.append(table, 0), local

    def __getitem__(self, part: slice) -> np.ndarray:
        local = self.local[part].astype(np.int64)
        return self.table[np.where(local == _MANY, len(self.table) - 1, local)]


class _Many:
    """Whether several documents of the pack have an entry; taken by slices."""

    def __init__(self, local: np.ndarray) -> None:
        self.local = local

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.local[part] == _MANY


def _unpack(blob: bytes | memoryview) -> tuple[np.ndarray, _Owners, _Many, np.ndarray | None]:
    """Digests, document ids, whether several documents of the pack have it, and checks."""
    kind, n, k = np.frombuffer(blob, "<i8", 3)
    at = 24 + 8 * k
    digests = _thick(blob, n, at) if kind == _PLAIN else np.frombuffer(blob, "<u8", n, at)
    checks = np.frombuffer(blob, "<u2", n, at + 8 * n) if kind == _CHECKED else None
    local = np.frombuffer(blob, "<u2", n, at + (6 if kind == _PLAIN else 10) * n)
    return digests, _Owners(np.frombuffer(blob, "<i8", k, 24), local), _Many(local), checks


def _several(digests: np.ndarray, checks: np.ndarray | None, owners: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether each digest stands in more than one document."""
    order = np.argsort(digests, kind="stable") if checks is None else np.lexsort((checks, digests))
    ordered = digests[order]
    new = ordered[1:] != ordered[:-1]
    if checks is not None:
        new |= checks[order][1:] != checks[order][:-1]
    at = np.flatnonzero(np.concatenate([[True], new]))
    low = np.minimum.reduceat(np.where(many, np.iinfo(np.int64).max, owners)[order], at)
    high = np.maximum.reduceat(np.where(many, np.iinfo(np.int64).min, owners)[order], at)
    flag = np.empty(len(digests), bool)
    flag[order] = np.repeat(np.logical_or.reduceat(many[order], at) | (low < high), np.diff(np.append(at, len(digests))))
    return flag


def answers(table: pa.Table, together: int) -> pa.Table:
    """All entries of one bucket -> per pack the digests that stand in more than one document; what a pack notes for itself is passed on.

    The entries stay packed but for one range of digests at a time, of about so many together."""
    packs, blobs = table.column("pack").to_pylist(), [memoryview(b.as_buffer()) for b in table.column("blob")]
    kinds = [int(np.frombuffer(b, "<i8", 1)[0]) for b in blobs]
    found = [(k, bytes(b)) for k, b, kind in zip(packs, blobs, kinds) if kind == _ALIVE]
    for kind in (_PLAIN, _CHECKED):
        parts = [(k, *_unpack(b)) for k, b, x in zip(packs, blobs, kinds) if x == kind]
        total = sum(len(p[1]) for p in parts)
        if not total:
            continue
        low, high = min(int(p[1][0]) for p in parts), max(int(p[1][-1]) for p in parts)
        ranges = -(-total // together)
        steps = np.array([low + (high + 1 - low) * k // ranges for k in range(1, ranges)], np.uint64)  # digests are spread evenly
        edges = [np.concatenate([[0], np.searchsorted(p[1], steps), [len(p[1])]]).astype(np.int64) for p in parts]
        told: list[list[tuple]] = [[] for _ in parts]
        for k in range(ranges):
            cuts = [slice(e[k], e[k + 1]) for e in edges]
            digests, owners, many = (np.concatenate([p[i][c] for p, c in zip(parts, cuts)]) for i in (1, 2, 3))
            if not len(digests):
                continue
            checks = np.concatenate([p[4][c] for p, c in zip(parts, cuts)]) if kind == _CHECKED else None
            flag, at = _several(digests, checks, owners, many), 0
            for own, c in zip(told, cuts):
                part = slice(at, at + c.stop - c.start)
                at = part.stop
                if flag[part].any():
                    own.append((digests[part][flag[part]], None if checks is None else checks[part][flag[part]]))
        for (pack, *_), own in zip(parts, told):
            if own:
                digests = np.concatenate([d for d, _ in own])
                body = _thin(digests) if kind == _PLAIN else digests.astype("<u8").tobytes() + np.concatenate([c for _, c in own]).astype("<u2").tobytes()
                found.append((pack, np.array([kind, len(digests)], "<i8").tobytes() + body))
    return pa.table({"pack": pa.array([k for k, _ in found], pa.int64()), "blob": pa.array([d for _, d in found], pa.binary())})


def _ask(table: pa.Table) -> pa.Table:
    return answers(table, TOGETHER)


def _worth(pack: int, step: int, mark: int, texts: np.ndarray, buckets: int) -> tuple:
    """A pack's note to itself, by way of any bucket: the texts of the blob that later steps need."""
    bucket = int(_mix(np.array([pack], np.int64).view(np.uint64))[0] % _U(buckets))
    return bucket, pack, np.array([_ALIVE, len(texts), step, mark], "<i8").tobytes() + texts.astype("<i4").tobytes()


def _blocks(packed: pa.Table, span: int, block_chars: int, known: Known) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Block]]:
    """Blocks of the texts that are worth a look: mark of the blob, the texts' places in it, ids, bases and the block."""
    for blob in packed.column("blob"):
        data = blob.as_py()
        mark = zlib.crc32(data)
        chosen = known.alive.get(mark)
        if chosen is not None and not len(chosen):
            continue
        ids, bases, texts = _decode(data)
        places = np.arange(len(texts)) if chosen is None else chosen
        start, size = 0, 0
        for i, place in enumerate(places):
            size += len(texts[place])
            if size >= block_chars or i == len(places) - 1:
                part = places[start : i + 1]
                yield mark, part, ids[part], bases[part], Block([texts[j] for j in part], span)
                start, size = i + 1, 0


def _round(step: int, span: int, buckets: int, block_chars: int) -> Callable:
    """The digests that a pack asks about in a step, given what it knows from the earlier ones."""

    def run(packed: pa.Table, flags: pa.Table | None = None) -> pa.Table:
        rows: list[tuple] = []
        known = Known(flags)
        for pack in packed.column("pack").unique().to_pylist():
            own = packed.filter(pa.compute.equal(packed.column("pack"), pack))
            asked: dict[int, list[tuple]] = {_PLAIN: [], _CHECKED: []}  # digests, checks, documents
            ids, loud, seen, worth = [], [], 0, {}
            for mark, places, block_ids, _, block in _blocks(own, span, block_chars, known):
                if step == 1:
                    found, whole = block.chunks()
                    asked[_PLAIN].append((found, None, block.cut_doc[whole] + seen))
                else:
                    low, high, core, stretch = block.groups(known)
                    if step == 3:  # all as of one document, so that only open groups make a digest known
                        may = known(core)
                        asked[_PLAIN].append((_told(core[may]), None, np.zeros(int(may.sum()), np.int64) + seen))
                        loud.append(~known.both((stretch[0][may], stretch[1][may])))
                        low = low[may]
                    elif step == 2:
                        asked[_PLAIN].append((core, None, block.doc(low) + seen))
                        asked[_CHECKED].append((*stretch, block.doc(low) + seen))
                    else:
                        asks = known(core) & (~known.both(stretch) | known(_told(core)))
                        p = _ranges(low[asks], high[asks] + 1)
                        asked[_CHECKED].append((*block.checked(p, p + span, _WINDOW), block.doc(p) + seen))
                    worth.setdefault(mark, []).append(places[np.unique(block.doc(low))])
                ids.append(block_ids if step != 3 else np.zeros(1, np.int64))
                seen += len(ids[-1])
            for kind, parts in asked.items():
                if parts:
                    digests, docs = (np.concatenate([x[i] for x in parts]) for i in (0, 2))
                    checks = np.concatenate([x[1] for x in parts]) if kind == _CHECKED else None
                    digests = digests & _PART if kind == _PLAIN else digests
                    rows += _entries(pack, digests, docs, np.concatenate(ids), np.concatenate(loud) if loud else None, buckets, checks)
            if step in (2, 3):
                rows += [_worth(pack, step, mark, np.concatenate(places), buckets) for mark, places in worth.items()]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "pack": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _told(core: np.ndarray) -> np.ndarray:
    """The digest by which an open core is made known."""
    return _mix(core + _U(_OPEN) * _SEEDS[2])


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges."""
    sizes = high - low
    if not sizes.sum():
        return np.zeros(0, np.int64)
    return np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _answer(span: int, block_chars: int) -> Callable:
    """The shared intervals of the documents of a pack."""

    def run(packed: pa.Table, flags: pa.Table) -> pa.Table:
        known, out = Known(flags), []
        for _, _, ids, bases, block in _blocks(packed, span, block_chars, known):
            low, high, core, stretch = block.groups(known)
            done = known.both(stretch)
            open_ = known(core) & ~done  # the windows of done groups are all shared
            p = _ranges(low[open_], high[open_] + 1)
            p = p[known.both(block.checked(p, p + span, _WINDOW))]
            starts, ends = np.concatenate([low[done], p]), np.concatenate([high[done], p]) + span
            if not len(starts):
                continue
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            doc = block.doc(starts)
            # ends never reach into the next document, so one running maximum serves all
            furthest = np.maximum.accumulate(ends)
            new = np.concatenate([[True], (starts[1:] > furthest[:-1]) | (doc[1:] != doc[:-1])])
            at = np.flatnonzero(new)
            doc = doc[at]
            base = bases[doc] - block.offsets[doc]
            out.append((ids[doc], starts[at] + base, furthest[np.append(at[1:], len(starts)) - 1] + base))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("doc_id", "start_pos", "end_pos"), columns)))

    return run


def shared_spans(
    documents: DataFrame, doc_id: Column, text: Column, span: int = 250, pack_chars: int = 2_000_000, part_chars: int = 500_000, block_chars: int = 500_000, partitions: int | None = None, buckets: int | None = None
) -> DataFrame:
    """doc_id, start_pos, end_pos: the longest runs of positions that lie in a stretch of at least span characters that another document has too.

    span must be at least 64 (two gear windows). pack_chars bounds what one task holds of the texts at a time, block_chars what it hashes at a time. partitions are those of
    spark.sql.shuffle.partitions unless given. A bucket of digests is handled by one task; unless given there are at least as many as partitions and one for each BUCKET_BYTES of packed
    text, up to 16,384 (more would leave a pack less than a few digests for each: then use larger packs and give the number)."""
    if span < 2 * GEAR:
        raise ValueError(f"span must be at least {2 * GEAR}")
    spark = documents.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(documents.select(doc_id).schema[0].dataType, IntegralType):
        keyed = documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id.cast("string")).alias("key"), text.alias("text")).where("doc_id is not null")
        found = shared_spans(keyed, F.col("key"), F.col("text"), span, pack_chars, part_chars, block_chars, partitions, buckets).withColumnRenamed("doc_id", "key")
        return found.join(keyed.select("doc_id", "key").distinct(), "key").select("doc_id", "start_pos", "end_pos")
    packed = packs(documents, doc_id, text, span, pack_chars, part_chars, partitions)
    if buckets is None:
        size = packed.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        buckets = max(partitions, min(_MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    flags: DataFrame | None = None
    for step in (1, 2, 3, 4):
        ask = _round(step, span, buckets, block_chars)
        schema = "bucket int, pack long, blob binary"
        if flags is None:
            entries = packed.mapInArrow(_each(ask), schema)
        else:
            entries = packed.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(ask, schema)
        told = entries.groupBy("bucket").applyInArrow(_ask, "pack long, blob binary")
        fresh = cut_lineage(told.repartition(partitions, "pack"), keep_partitioning=True)  # a union of such tables stays partitioned, so what is known is shuffled once
        flags = fresh if flags is None else flags.unionByName(fresh)
    found = packed.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(_answer(span, block_chars), "doc_id long, start_pos long, end_pos long")
    # parts of a long document overlap, so its runs may touch
    order = Window.partitionBy("doc_id").orderBy("start_pos")
    furthest = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce((F.col("start_pos") > furthest).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("run")


def _each(ask: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return run
