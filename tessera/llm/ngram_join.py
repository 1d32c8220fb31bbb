"""N-gram Jaccard self-join by a prefix tree.

Sets of k-word shingles (64-bit hashes) link when their Jaccard similarity reaches ``percent`` / 100. Equal sets are one
class, and classes are joined:

1. *Count filter, without loss.* A set of n shingles that links with another one shares all but ``(1 - percent / 100) n``
   of its shingles. Shingles under a bound on the hash, ``SAMPLE`` times as many as may be missing, are counted over all
   classes; a class stays if it has no more that are nowhere else than may be missing. Most texts go here, whatever the
   size of the table, because chance shares a few shingles of a text, not most of them.
2. *Global order.* Of the classes that stay all shingles are counted, again over all of them. Those found in one class
   only are dropped from the sets (n remembers them), and classes that shared too few go. The rest of each set is put in
   the one global order, most frequent first, ties by hash.
3. *Routing, without loss.* Within a size class, sets that may link differ in at most D shingles, so of D + 1 ranges of
   the hash space at least one holds the same shingles in both. Each set sends a hash of each range's content, for its
   own class and the next (a partner may be larger by ``100 / percent``); sets that meet in no range can't link.
   Empty ranges tell nothing; a class has some ranges to spare for them. Two sets are sure to meet if either has no more
   empty ones than that; a set that has more deals its shingles anew by another hash, and so does any such partner.
   The first deal leaves out shingles that many sets share (any set of them keeps the bound, as two sets differ in no
   more without them), so that a passage in many texts doesn't bring those together.
   Chance brings very many sets together in a large table. So signatures are dealt by size class, and with a class's
   signatures each set sends the parity of how many of its shingles fall on each bit of a map, 2 bits or more a shingle.
   Two sets differ in at least as many shingles as their maps in bits, which tells of most pairs that meet that they
   can't link. A task keeps only whether sets are joined yet: it passes on at most one edge for each set, however many
   sets share its signatures. A signature of more than ``MEET`` classes joins them without a look.
   What is left is gathered in candidate groups (connected components, distributed).
4. *Prefix tree.* The ordered sets of a group go into a tree whose edges hold runs of shingles, so common parts are held
   and compared once. A set walks the tree from the root with its overlap so far, which all sets below a node share; a
   subtree is left as soon as what remains of the set and of the longest set below cannot reach the overlap that the
   shortest set below needs, or if all below are in the set's component already.
   Groups over a bound are cut into parts by a hash. Each part meets the next one; then what is still outside its
   group's largest component meets what of the group is near it in size, in tasks of bounded size.

Between tasks hashes travel in binary blocks, with each class named once a block. A shingle or signature that very many
texts share sends one entry from each flush of a task for each class, equal texts one entry in all. Texts are not shuffled:
which of them may be of candidates is told by a bit set of fixed size, where a false alarm costs only time. Sets are told
apart by 128 bits (size and two sums of hashes); between tasks they go by 64 of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytewords import U, mix, shingles, words
from tessera.llm.common import Utf8, column_of, forget, lean, partitions, small_batches, split_by_bits, written
from tessera.llm.components import components, local_roots

#: The count filter looks at so many times the share of shingles that may be missing.
SAMPLE = 1.5
#: Entries that a task deals out at a time, and that a receiving task gets on average at most.
HOLD, RECEIVE = 1_000_000, 2_000_000
#: The first deal of signatures leaves out shingles of so many sets.
OFTEN = 64
#: How often a set with too many empty ranges is dealt anew; after that its empty ranges count as well.
SALTS = 8
#: Of a signature of so many classes all pairs are looked at; the classes of larger ones are of one group.
MEET = 64
#: Bits of a parity map for each shingle of its size class's largest set, and at least.
MAP_BITS, LEAST_BITS = 2, 256
#: Bounds of a part of a group, and of a heap that meets parts; a task holds two of them at a time.
PART_SETS, PART_SHINGLES = 4096, 500_000
#: Rows of an Arrow batch with texts or sets.
TEXT_ROWS = 1000


def text_sets(batch: pa.RecordBatch, k: int, column: str = "text"):
    """(row, ascending distinct shingle hashes) for each text of a batch."""
    texts = Utf8(column_of(batch, column))
    for i, j in texts.slices():
        h, counts = words(texts.data, texts.offsets[i : j + 1])
        ends = np.cumsum(counts)
        for r in range(i, j):
            yield r, shingles(h[ends[r - i] - counts[r - i] : ends[r - i]], k)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    m = mix(s ^ U(0xA0761D6478BD642F))
    return int((m.sum(dtype=np.uint64)).view(np.int64)), int((mix(m ^ U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)).view(np.int64))


# -- blocks between tasks


def _firsts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _blocks(part: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each part: keys, the number of entries of each key, and the entries' values, all as bytes."""
    order = np.argsort(part, kind="stable")
    part, keys, values = part[order], keys[order], [v[order] for v in values]
    at = np.append(_firsts_of(part), len(part))
    rows = [[] for _ in range(3 + len(values))]
    for lo, hi in zip(at, at[1:], strict=False):
        first = _firsts_of(keys[lo:hi])
        rows[0].append(int(part[lo]))
        rows[1].append(keys[lo:hi][first].tobytes())
        rows[2].append(np.diff(np.append(first, hi - lo)).astype(np.uint32).tobytes())
        for column, v in zip(rows[3:], values, strict=True):
            column.append(v[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["p", "keys", "counts", "x", "y"][: 3 + len(values)])


def _received(batches, *kinds):
    """(keys, values, ...) of all entries of each part; rows come sorted by part."""

    def whole(held):
        keys = np.repeat(np.frombuffer(b"".join(h[0] for h in held), np.int64), np.frombuffer(b"".join(h[1] for h in held), np.uint32))
        return keys, *(np.frombuffer(b"".join(h[2 + i] for h in held), kind) for i, kind in enumerate(kinds))

    last, held = None, []
    for b in batches:
        for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != last and held:
                yield whole(held)
                held = []
            last = p
            held.append(row)
    if held:
        yield whole(held)


def _shared(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, hash, number of keys) of the distinct entries whose hash has two keys or more."""
    order = np.argsort(h)
    keys, h = keys[order], h[order]
    first = _firsts_of(h)
    n = np.diff(np.append(first, len(h)))
    several = np.repeat(n > 1, n)
    keys, h = keys[several], h[several]
    order = np.lexsort((keys, h))
    keys, h = keys[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])) if len(h) else np.zeros(0, bool)
    keys, h = keys[new], h[new]
    n = np.diff(np.append(_firsts_of(h), len(h)))
    n = np.repeat(n, n)
    return keys[n > 1], h[n > 1], n[n > 1].astype(np.uint32)


def _exchange(sent: DataFrame, parts: int, receive, schema: str) -> DataFrame:
    """What ``receive`` makes of the blocks of each part."""
    return sent.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(lean(receive), schema)


# -- classes, count filter, global order


def _describe(k: int, percent: int, limit: int):
    def run(batches):
        for b in batches:
            n, x, y, need = [], [], [], []
            for _, s in text_sets(b, k):
                f = _fingerprint(s)
                n.append(len(s))
                x.append(f[0])
                y.append(f[1])
                need.append(int(np.searchsorted(s, U(limit), "right")) - (100 - percent) * len(s) // 100)
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), *(pa.array(c, pa.int64()) for c in (n, x, y, need))], ["doc_id", "n", "f1", "f2", "need"])

    return run


def _send_sets(k: int, parts: int, limit: int = (1 << 64) - 1):
    """Blocks of the shingles up to ``limit``, keyed by the first fingerprint of their set."""

    def run(batches):
        held, names, seen, size = [], [], set(), 0

        def flush():
            h = np.concatenate(held)
            return _blocks((h % U(parts)).astype(np.int64), np.repeat(np.array(names, np.int64), [len(s) for s in held]), h)

        for b in batches:
            ids = column_of(b, "doc_id")
            for r, s in text_sets(b, k):
                if not len(s) or not ids[r].is_valid:
                    continue
                f = _fingerprint(s)
                if f in seen:
                    continue  # an equal set of this flush has sent the same
                seen.add(f)
                held.append(s[: np.searchsorted(s, U(limit), "right")].copy())
                names.append(f[0])
                size += len(held[-1]) + 8
                if size >= HOLD:
                    yield flush()
                    held, names, seen, size = [], [], set(), 0
        if held:
            yield flush()

    return run


def _count_shared(parts: int):
    """How many of each set's shingles other sets have too, in blocks by set."""

    def run(batches):
        for keys, h in _received(batches, np.uint64):
            got, n = np.unique(_shared(keys, h)[0], return_counts=True)
            if len(got):
                yield _blocks((mix(got.view(np.uint64)) % U(parts)).astype(np.int64), got, n)

    return run


def _sum_shared(batches):
    for keys, n in _received(batches, np.int64):
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = _firsts_of(keys)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.add.reduceat(n, at))], ["key", "shared"])


def _return_sets(parts: int):
    """The shared shingles of each part with their frequency, in blocks by class."""

    def run(batches):
        for keys, h in _received(batches, np.uint64):
            keys, h, n = _shared(keys, h)
            if len(keys):
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                yield _blocks((mix(keys.view(np.uint64)) % U(parts)).astype(np.int64), keys, h[order], n[order])

    return run


def _ordered_sets(batches):
    """(class, its shared shingles in the global order, their frequencies)."""
    for keys, h, n in _received(batches, np.uint64, np.uint32):
        order = np.lexsort((h, -n.astype(np.int64), keys))
        keys, h, n = keys[order], h[order], n[order]
        at = np.append(_firsts_of(keys), len(keys))
        for lo in range(0, len(at) - 1, TEXT_ROWS):
            cut = at[lo : lo + TEXT_ROWS + 1]
            spans = list(zip(cut, cut[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cut[:-1]]), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(np.diff(cut))], ["key", "shingles", "often", "m"]
            )


# -- routing


def _class_bounds(percent: int, upto: int) -> list[int]:
    """Ascending upper bounds of size classes; a set of class c links only with sets of classes c-1, c and c+1."""
    out, a = [], 0
    while a < upto:
        a = max(a + 1, (a + 1) * 100 // percent)
        out.append(a)
    return out


def ranges_of(n: int, percent: int, bounds: list[int]) -> list[tuple[int, int, int]]:
    """(class, ranges, spare ranges) that a set of n shingles sends: its own class and that of its largest partners."""
    out = []
    lo = next(c for c, a in enumerate(bounds) if a >= n)
    hi = next(c for c, a in enumerate(bounds) if a >= n * 100 // percent)
    for c in range(lo, hi + 1):
        d = 2 * (100 - percent) * bounds[c] // (100 + percent)
        spare = 1 + d // 16
        if d:  # else only equal sets link, and they are one class
            out.append((c, d + 1 + spare, spare))
    return out


def signatures(n: int, s: np.ndarray, rare: np.ndarray, percent: int, bounds: list[int], memo: dict) -> list[tuple[int, np.ndarray]]:
    """By size class, the hashes under which a set of n shingles, ``s`` those that others have too, ascending, meets those it may link with.

    The first deal takes only those marked ``rare``.
    """
    if n not in memo:
        memo[n] = ranges_of(n, percent, bounds)
    out, dealt = [], {}
    for c, m, spare in memo[n]:
        for salt in range(SALTS):
            if salt not in dealt:
                v = np.sort(mix(s + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) if salt else s[rare]
                total = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(mix(v), out=total[1:])
                dealt[salt] = v, total
            v, total = dealt[salt]
            if (c, m, salt) not in memo:
                memo[c, m, salt] = np.array([(i << 64) // m for i in range(m)], np.uint64), mix(np.arange(m, dtype=np.uint64) + U((c << 36) + (salt << 32)))
            edges, names = memo[c, m, salt]
            at = np.append(np.searchsorted(v, edges), len(v))
            full = at[1:] > at[:-1]
            sig = mix((total[at[1:]] - total[at[:-1]]) ^ names)
            enough = m - int(full.sum()) <= spare
            out.append((c, sig[full] if enough or salt + 1 < SALTS else sig))
            if enough:
                break
    return out


def map_words(c: int, bounds: list[int]) -> int:
    """64-bit words of a parity map of a size class."""
    return -(-max(LEAST_BITS, MAP_BITS * bounds[c]) // 64)


def parity_map(s: np.ndarray, words: int) -> np.ndarray:
    """For each bit whether an odd number of the shingles fall on it."""
    return np.packbits((np.bincount((s % U(64 * words)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def may_link(n: np.ndarray, m: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs of sets that can't link: ``n`` shingles, of which the maps know ``m``; the others nobody shares."""
    out = np.zeros(len(i), bool)
    step = max(1, HOLD // maps.shape[1])
    for lo in range(0, len(i), step):
        x, y = i[lo : lo + step], j[lo : lo + step]
        differ = np.maximum(np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64), np.abs(m[x] - m[y]))
        out[lo : lo + step] = (100 + percent) * ((m[x] + m[y] - differ) // 2) >= percent * (n[x] + n[y])
    return out


def _by_signature(sig: np.ndarray, who: np.ndarray, more: np.ndarray | None = None):
    """(signatures, classes, where runs of one signature begin, their lengths, ``more``), a run's smallest class first."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    at = _firsts_of(sig)
    return sig, who, at, np.diff(np.append(at, len(who))), None if more is None else more[order]


def _stars(who: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the runs given, each with the smallest of its run."""
    a, b = who[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], np.repeat(who[at], n)
    return a[a != b], b[a != b]


def _all_pairs(who: np.ndarray, at: np.ndarray, n: np.ndarray, hold: int):
    """Batches of about ``hold`` pairs (larger class, smaller class) of each run."""
    for size in np.unique(n[n > 1]):
        i, j = np.triu_indices(size, 1)
        starts, step = at[n == size], max(1, hold // len(i))
        for lo in range(0, len(starts), step):
            rows = who[starts[lo : lo + step, None] + np.arange(size)]
            a, b = rows[:, j].ravel(), rows[:, i].ravel()
            yield a[a != b], b[a != b]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = local_roots(a, b) if len(a) else (a, b)
    return nodes[nodes != roots], roots[nodes != roots]


class Inboxes:
    """Where signatures go: each size class has so many inboxes of its own that one gets about ``receive`` entries."""

    def __init__(self, entries: dict[int, int], receive: int):
        self.of = {c: max(1, math.ceil(n / receive)) for c, n in sorted(entries.items())}
        self.first, self.classes = {}, []
        for c, n in self.of.items():
            self.first[c] = len(self.classes)
            self.classes += [c] * n

    def __len__(self) -> int:
        return len(self.classes)


def _count_entries(percent: int):
    """(size class, entries) for rows (n, count)."""

    def run(batches):
        bounds, entries = _class_bounds(percent, 1 << 40), {}
        for batch in batches:
            for n, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c, m, _ in ranges_of(n, percent, bounds):
                    entries[c] = entries.get(c, 0) + m * count
        yield pa.RecordBatch.from_arrays([pa.array(list(entries), pa.int64()), pa.array(list(entries.values()), pa.int64())], ["c", "entries"])

    return run


def _send_signatures(percent: int, inboxes: Inboxes, often: int):
    """Blocks of signatures, ``MEET`` entries and one more for each in a flush at most, keyed by class; ``maps`` holds n, m
    and the parity map of each class named. Edges among more classes that share one come in parts after the inboxes."""

    def run(batches):
        bounds, memo = _class_bounds(percent, 1 << 40), {}
        sigs, names, to, maps, size = [], [], [], {}, 0

        def flush():
            held = [len(s) for s in sigs]
            sig, who, at, n, c = _by_signature(np.concatenate(sigs), np.repeat(np.array(names, np.int64), held), np.repeat(np.array(to, np.int64), held))
            a, b = _forest(*_stars(who, at[n > MEET], n[n > MEET]))
            some = np.arange(len(who)) - np.repeat(at, n) <= MEET  # so many tell the receiver that there are edges
            sig, who, c = sig[some], who[some], c[some]
            order = np.argsort(who, kind="stable")
            sig, who, c = sig[order], who[order], c[order]
            kinds, c = np.unique(c, return_inverse=True)
            first, of = (np.array([x[k] for k in kinds.tolist()], np.int64) for x in (inboxes.first, inboxes.of))
            sent = _blocks(first[c] + (sig % of.astype(np.uint64)[c]).astype(np.int64), who, sig)
            parts, keys = (sent.column(x).to_pylist() for x in (0, 1))
            yield with_maps(sent, [b"".join(maps[inboxes.classes[p], k] for k in np.frombuffer(named, np.int64).tolist()) for p, named in zip(parts, keys, strict=True)])
            if len(a):
                sent = _blocks(len(inboxes) + a % max(1, len(inboxes)), a, b.view(np.uint64))
                yield with_maps(sent, [b""] * sent.num_rows)

        def with_maps(sent, held):
            return pa.RecordBatch.from_arrays([*sent.columns, pa.array(held, pa.binary())], ["p", "keys", "counts", "x", "maps"])

        for batch in batches:
            for cid, n, raw, counts in zip(*(column_of(batch, c).to_pylist() for c in ("cid", "n", "shingles", "often")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                order = np.argsort(s)
                for c, sig in signatures(n, s[order], np.frombuffer(counts, np.uint32)[order] < often, percent, bounds, memo):
                    if not len(sig):
                        continue
                    sigs.append(sig)
                    names.append(cid)
                    to.append(c)
                    size += len(sig)
                    if (c, cid) not in maps:
                        maps[c, cid] = np.array([n, len(s)], np.uint64).tobytes() + parity_map(s, map_words(c, bounds)).tobytes()
                        size += len(maps[c, cid]) // 16
                if size >= HOLD:
                    yield from flush()
                    sigs, names, to, maps, size = [], [], [], {}, 0
        if sigs:
            yield from flush()

    return run


def _meet(percent: int, inboxes: Inboxes):
    """A spanning forest, for each inbox, of the classes that share a signature there and may link."""

    def run(batches):
        bounds = _class_bounds(percent, 1 << 40)

        def joined(label, a, b):
            if len(a):
                nodes, roots = local_roots(label[a], label[b])
                to = np.arange(len(label))
                to[nodes] = roots
                label = to[label]
            return label

        for (p,), rows in _groups(batches, 1):
            keys, counts, x = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in enumerate((np.int64, np.uint32, np.uint64)))
            if p >= len(inboxes):
                a, b = _forest(np.repeat(keys, counts), x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                continue
            held = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(keys), -1)
            assert held.shape[1] == 2 + map_words(inboxes.classes[p], bounds)
            del rows
            n, m, maps = held[:, 0].astype(np.int64), held[:, 1].astype(np.int64), held[:, 2:]
            _, who, at, run, _ = _by_signature(x, np.repeat(np.arange(len(keys)), counts))
            label = joined(np.arange(len(keys)), *_stars(who, at[run > MEET], run[run > MEET]))
            for a, b in _all_pairs(who, at[run <= MEET], run[run <= MEET], HOLD // 4):
                apart = label[a] != label[b]
                a, b = np.divmod(np.unique(a[apart] * len(keys) + b[apart]), len(keys))
                may = may_link(n, m, maps, a, b, percent)
                label = joined(label, a[may], b[may])
            others = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(keys[others]), pa.array(keys[label[others]])], ["a", "b"])

    return run


# -- prefix tree


class PrefixTree:
    """Sets in the global order, in a tree whose edges hold runs of ranks; nodes are numbered level by level, children of a node in a row."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], often: list[np.ndarray]):
        self.sizes = np.asarray(sizes, np.int64)  # with the shingles that nobody shares
        values, at, inverse = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
        rank = np.empty(len(values), np.int32)
        rank[np.lexsort((values, -np.concatenate(often)[at].astype(np.int64)))] = np.arange(len(values), dtype=np.int32)
        held = np.array([len(s) for s in sets])
        ends = np.cumsum(held)
        self.ranks = [rank[inverse[e - n : e]] for e, n in zip(ends, held, strict=True)]
        del inverse
        self.mark = np.zeros(len(values), bool)
        keys = [r.astype(">u4").tobytes() for r in self.ranks]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        del keys
        nodes, leaf = self._grow()
        self._number(nodes, leaf, held)

    def _grow(self):
        """Nodes [start of the run, its end, whose ranks, parent], and the node where each set ends."""
        nodes: list[list] = []
        stack: list[int] = []
        leaf = np.empty(len(self.ranks), np.int64)
        before = None
        for i in self.order:
            r, depth = self.ranks[i], 0
            if before is not None:
                m = min(len(before), len(r))
                differ = before[:m] != r[:m]
                depth = int(differ.argmax()) if differ.any() else m
            while stack and nodes[stack[-1]][0] >= depth and nodes[stack[-1]][1] > depth:
                stack.pop()
            if stack and nodes[stack[-1]][1] > depth:  # the run is cut where the sets part
                top = stack.pop()
                start, end, who, parent = nodes[top]
                nodes.append([start, depth, who, parent])
                nodes[top] = [depth, end, who, len(nodes) - 1]
                stack.append(len(nodes) - 1)
            if len(r) > depth:
                nodes.append([depth, len(r), int(i), stack[-1] if stack else -1])
                stack.append(len(nodes) - 1)
            leaf[i] = stack[-1]
            before = r
        return nodes, leaf

    def _number(self, nodes, leaf, held):
        children: dict[int, list[int]] = {}
        for x, node in enumerate(nodes):
            children.setdefault(node[3], []).append(x)
        new, todo = np.empty(len(nodes), np.int64), children.get(-1, [])
        listed, levels = [], []
        while todo:
            new[todo] = np.arange(len(listed), len(listed) + len(todo))
            levels.append((len(listed), len(listed) + len(todo)))
            listed.extend(todo)
            todo = [c for x in todo for c in children.get(x, ())]
        self.roots = len(children.get(-1, []))
        self.child_count = np.array([len(children.get(x, ())) for x in listed], np.int64)
        self.child_first = self.roots + np.cumsum(self.child_count) - self.child_count
        self.until = np.array([nodes[x][1] for x in listed], np.int64)
        self.length = np.array([nodes[x][1] - nodes[x][0] for x in listed], np.int64)
        self.run_at = np.cumsum(self.length) - self.length
        self.runs = np.concatenate([self.ranks[nodes[x][2]][nodes[x][0] : nodes[x][1]] for x in listed])
        self.last = self.runs[self.run_at + self.length - 1]
        self.leaf = new[leaf]
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        self.longest, self.shortest = np.zeros(len(listed), np.int64), np.full(len(listed), np.iinfo(np.int64).max)
        self.from_, self.to = np.full(len(listed), len(place)), np.zeros(len(listed), np.int64)  # which sets, in order, are below
        np.maximum.at(self.longest, self.leaf, held)
        np.minimum.at(self.shortest, self.leaf, self.sizes)
        np.minimum.at(self.from_, self.leaf, place)
        np.maximum.at(self.to, self.leaf, place + 1)
        parent = np.array([new[nodes[x][3]] if nodes[x][3] >= 0 else -1 for x in listed], np.int64)
        for lo, hi in reversed(levels[1:]):
            up = parent[lo:hi]
            np.maximum.at(self.longest, up, self.longest[lo:hi])
            np.minimum.at(self.shortest, up, self.shortest[lo:hi])
            np.minimum.at(self.from_, up, self.from_[lo:hi])
            np.maximum.at(self.to, up, self.to[lo:hi])

    def linked(self, i: int, percent: int, wanted: np.ndarray) -> np.ndarray:
        """The wanted sets (a mask) that link with set ``i``."""
        ranks, n = self.ranks[i], int(self.sizes[i])
        below = np.concatenate([[0], np.cumsum(wanted[self.order])])
        self.mark[ranks] = True
        overlap = np.full(len(self.until), -1, np.int64)  # of the nodes walked
        nodes, so_far = np.arange(self.roots), np.zeros(self.roots, np.int64)
        while len(nodes):
            some = below[self.to[nodes]] > below[self.from_[nodes]]
            nodes, so_far = nodes[some], so_far[some]
            if not len(nodes):
                break
            length = self.length[nodes]
            begin = np.cumsum(length) - length
            hit = self.mark[self.runs[np.repeat(self.run_at[nodes] - begin, length) + np.arange(int(length.sum()))]]
            so_far = so_far + np.add.reduceat(hit, begin, dtype=np.int64)
            # the ranks still to come bound what set and subtree can share
            rest = np.minimum(self.longest[nodes] - self.until[nodes], len(ranks) - np.searchsorted(ranks, self.last[nodes], side="right"))
            # 100 o >= percent (n + m - o), with m the shortest below
            alive = (100 + percent) * (so_far + rest) >= percent * (n + self.shortest[nodes])
            nodes, so_far = nodes[alive], so_far[alive]
            overlap[nodes] = so_far
            count = self.child_count[nodes]
            begin = np.cumsum(count) - count
            nodes, so_far = np.repeat(self.child_first[nodes] - begin, count) + np.arange(int(count.sum())), np.repeat(so_far, count)
        self.mark[ranks] = False
        got = overlap[self.leaf]
        return np.flatnonzero(wanted & (got >= 0) & ((100 + percent) * got >= percent * (n + self.sizes)))


def tree_links(names: np.ndarray, tree: PrefixTree, percent: int, side: np.ndarray | None = None, component: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all components of the sets, and no others; ``side`` 0/1 asks only for links from 0 to 1."""
    n = len(names)
    label = np.unique(component, return_inverse=True)[1] if component is not None else np.arange(n)
    position = np.empty(n, np.int64)
    position[tree.order] = np.arange(n)
    out = []
    for i in tree.order:
        if side is not None and side[i]:
            continue
        wanted = label != label[i]
        wanted &= position > position[i] if side is None else side == 1
        if not wanted.any():
            continue
        found = tree.linked(int(i), percent, wanted)
        if len(found):
            others, first = np.unique(label[found], return_index=True)
            out.extend((int(names[i]), int(names[j])) for j in found[first])
            label[np.isin(label, others)] = label[i]
    return out


def _groups(batches, keys: int):
    """(key, rows) for rows that come sorted by their first ``keys`` columns."""
    last, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != last and held:
                yield last, held
                held = []
            last = row[:keys]
            held.append(row[keys:])
    if held:
        yield last, held


def _edges_batch(edges):
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _tree(rows) -> PrefixTree:
    """The tree of rows that end with n, shingles and their frequencies."""
    return PrefixTree(np.array([r[-3] for r in rows]), [np.frombuffer(r[-2], np.uint64) for r in rows], [np.frombuffer(r[-1], np.uint32) for r in rows])


def _within(percent: int):
    def run(batches):
        for _, rows in _groups(batches, 2):
            if len(rows) > 1:
                edges = tree_links(np.array([r[0] for r in rows]), _tree(rows), percent)
                if edges:
                    yield _edges_batch(edges)

    return run


def _across(percent: int):
    def run(batches):
        for _, rows in _groups(batches, 4):
            side = np.array([r[0] for r in rows])
            if side.min() == side.max():
                continue
            edges = tree_links(np.array([r[1] for r in rows]), _tree(rows), percent, side, np.array([r[2] for r in rows]))
            if edges:
                yield _edges_batch(edges)

    return run


def _class_links(sets: DataFrame, percent: int, part_sets: int, part_shingles: int, receive: int, often: int) -> DataFrame:
    """Edges (a, b) that join the classes of ``sets`` (cid, n, shingles, often, m) into the components of their links."""
    spark = sets.sparkSession
    parts = max(partitions(spark), 1)
    entries = sets.groupBy("n").count().mapInArrow(lean(_count_entries(percent)), "c long, entries long").groupBy("c").agg(F.sum("entries"))
    inboxes = Inboxes(dict(tuple(r) for r in entries.collect()), receive)  # a row for each size class
    with small_batches(spark, TEXT_ROWS):
        sent = sets.select("cid", "n", "shingles", "often").mapInArrow(lean(_send_signatures(percent, inboxes, often)), "p long, keys binary, counts binary, x binary, maps binary")
    with small_batches(spark):
        met = written(_exchange(sent, parts, _meet(percent, inboxes), "a long, b long"), "met")
    groups = components(met)
    grouped = sets.select("cid", "n", "m").join(groups, F.col("cid") == F.col("node")).select("cid", F.col("component").alias("block"), "n", "m")
    grouped = written(grouped, "candidates")
    forget(met)
    bound = lambda n: F.greatest(F.ceil(F.count(F.lit(1)) / part_sets), F.ceil(F.sum(n) / part_shingles)).cast("long")
    sizes = grouped.groupBy("block").agg(bound("m").alias("parts"))
    placed = written(grouped.join(sizes, "block").select(F.col("cid").alias("d"), "block", "parts", "n", "m", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part")), "blocks")
    forget(grouped)
    held = sets.select("cid", "shingles", "often")
    with small_batches(spark, TEXT_ROWS):
        within = placed.join(held, F.col("d") == F.col("cid")).select("block", "part", "d", "n", "shingles", "often")
        within = within.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "d")
        links = written(within.mapInArrow(lean(_within(percent)), "a long, b long"), "links")

    large = placed.where("parts > 1")
    if large.isEmpty():
        return links
    # from here on only the sets of these groups are read
    held = written(held.join(large.select("d"), F.col("cid") == F.col("d")).select("cid", "shingles", "often"), "large")

    def labelled():
        c = components(links)
        return written(large.join(c, large["d"] == c["node"], "left").select("d", "block", "part", "parts", "n", "m", F.coalesce("component", "d").alias("comp")), "parts")

    def across(rows):
        rows = rows.join(held, F.col("d") == F.col("cid")).select("block", "band", "i", "j", "side", "d", "comp", "n", "shingles", "often")
        with small_batches(spark, TEXT_ROWS):
            return written(links.unionByName(rows.repartition(parts, "block", "band", "i", "j").sortWithinPartitions("block", "band", "i", "j", "side", "d").mapInArrow(lean(_across(percent)), "a long, b long")), "links")

    # each part with the next: parts of one large group of near copies come together here
    now = labelled()
    i = F.explode(F.array(F.struct(F.col("part").alias("i"), F.lit(0).alias("side")), F.struct(F.pmod(F.col("part") - 1, F.col("parts")).alias("i"), F.lit(1).alias("side"))))
    zero = F.lit(0).cast("long")
    before, links = links, across(now.select("d", "block", "comp", "n", "parts", i.alias("e")).select("d", "block", zero.alias("band"), F.col("e.i").alias("i"), zero.alias("j"), "e.side", "comp", "n"))
    forget(before)
    forget(now)
    # what is outside its block's largest component against what of the block is of a size that may link: sets that
    # link are of the same band of sizes or of neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("long")
    labels = labelled()
    tops = labels.groupBy("block", "comp").count().groupBy("block").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all"))
    now = labels.withColumn("band", band).join(tops.where("all > top.count").select("block", F.col("top.comp").alias("main")), "block")
    heaps = written(now.where("comp <> main").groupBy("block", "band").agg(bound("m").alias("heaps")), "heaps")
    near = F.explode(F.array(*[F.col("band") + x for x in (-1, 0, 1)]))
    shelves = now.select("block", "m", near.alias("band")).groupBy("block", "band").agg(bound("m").alias("shelves")).join(heaps, ["block", "band"])
    shelves = written(shelves, "shelves")
    upto = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    i, j = F.pmod(F.xxhash64("d", F.lit(1)), F.col("heaps")).alias("i"), F.pmod(F.xxhash64("d", F.lit(2)), F.col("shelves")).alias("j")
    every = now.select("d", "block", "comp", "n", near.alias("band")).join(shelves, ["block", "band"])
    every = every.select("d", "block", "band", upto("heaps").alias("i"), j, F.lit(1).alias("side"), "comp", "n")
    rest = now.where("comp <> main").join(shelves, ["block", "band"])
    rest = rest.select("d", "block", "band", i, upto("shelves").alias("j"), F.lit(0).alias("side"), "comp", "n")
    before, links = links, across(rest.unionByName(every))
    for done in (before, labels, heaps, shelves, placed, held):
        forget(done)
    return links


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, part_sets: int = PART_SETS, part_shingles: int = PART_SHINGLES, receive: int = RECEIVE, often: int = OFTEN) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text).

    Texts link when ``100 * |A & B| >= percent * |A | B|`` over their distinct k-word shingles (all words where a text
    has fewer than k); component_id is the smallest doc_id reachable by links. Null, empty and blank texts have no
    shingles and link with nothing. Rows of one doc_id count as one document: what any of its texts links with is
    linked with all of them. A null doc_id links with nothing and has a null component. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    limit = min((1 << 64) - 1, int(SAMPLE * (100 - percent) / 100 * (1 << 64)))
    parts = max(partitions(spark), 1)
    key = ["n", "f1", "f2"]
    with small_batches(spark, TEXT_ROWS):
        told = written(src.mapInArrow(lean(_describe(k, percent, limit)), "doc_id long, n long, f1 long, f2 long, need long"), "sets")
    classes = told.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    inboxes = lambda entries: max(1, parts // 4, math.ceil((entries or 0) / receive))
    blocks = "p long, keys binary, counts binary, x binary"
    with small_batches(spark, TEXT_ROWS):
        some = inboxes((told.agg(F.sum("n")).first()[0] or 0) * (limit / (1 << 64)))
        sent = _exchange(src.mapInArrow(lean(_send_sets(k, some, limit)), blocks), some, _count_shared(some), blocks)
        counts = _exchange(sent, some, _sum_shared, "key long, shared long")
        found = classes.join(counts, F.col("f1") == F.col("key"), "left").where("need <= coalesce(shared, 0)")
        found = written(found.select("cid", *key, "rep"), "candidates")

        some = inboxes(found.agg(F.sum("n")).first()[0])
        texts, _ = split_by_bits(src, "doc_id", found.select("rep"))
        sent = _exchange(texts.mapInArrow(lean(_send_sets(k, some)), blocks), some, _return_sets(some), blocks + ", y binary")
        sets = _exchange(sent, some, _ordered_sets, "key long, shingles binary, often binary, m long")
        sets = sets.join(found.select("f1", "cid", "n"), F.col("key") == F.col("f1")).where(F.col("m") * 100 >= F.col("n") * percent)
        sets = written(sets.select("cid", "n", "shingles", "often", "m"), "members")
    links = _class_links(sets, percent, part_sets, part_shingles, receive, often)

    # a doc_id with several texts joins their classes
    several = told.where("n > 0 and doc_id is not null").select("doc_id", *key).distinct()
    several = several.join(several.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__d")), F.col("doc_id") == F.col("__d"))
    several = several.join(classes.select(*key, "cid"), key).select("doc_id", "cid")
    alike = several.join(several.groupBy("doc_id").agg(F.min("cid").alias("b")), "doc_id").select(F.col("cid").alias("a"), "b")
    joined = components(links.unionByName(alike))
    joined = classes.join(joined, F.col("cid") == F.col("node")).select("cid", "component", "rep")
    lowest = joined.join(joined.groupBy("component").agg(F.min("rep").alias("low")), "component").select(F.col("cid").alias("__c"), "low")
    changed = classes.join(lowest, F.col("cid") == F.col("__c"), "left").where("rows > 1 or low is not null")
    changed = written(changed.select(*[F.col(c).alias(f"__{c}") for c in key], "rows", F.coalesce("low", "rep").alias("low")), "changed")
    # classes of very many rows, at most 8 for each partition, by broadcast; the others meet their rows by an equi-join
    total = told.count()
    many = F.col("rows") > F.lit(max(1.0, total / (8 * parts)))
    same = [F.col(c) == F.col(f"__{c}") for c in key]
    whole = told.join(F.broadcast(changed.where(many).withColumnRenamed("low", "hot").drop("rows")), same, "left").select("doc_id", *key, "hot")
    light = changed.where(~many).drop("rows")
    out = whole.where("hot is null and n > 0").join(light, same, "left").select("doc_id", "n", F.coalesce("low", "doc_id").alias("component_id"))
    out = out.unionByName(whole.where("hot is not null or n = 0").select("doc_id", "n", F.coalesce("hot", "doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of whole documents by 4-word shingles at 85 %."""
    from tessera.llm.common import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)
