"""Suffix order and common prefixes of one shard by induced sorting, with queues that spill to disk."""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries that the queues of one sort keep in memory.
IN_MEMORY = 1 << 22


class Block:
    """Suffix tuples in order: positions, common prefix with the entry before (within the block), and what the block was induced from."""

    def __init__(self, pos: np.ndarray, lcp: np.ndarray, origin: tuple[int, int]):
        self.pos, self.lcp, self.origin = pos, lcp, origin


class SpillQueue:
    """A priority queue of blocks by first symbol; blocks of a symbol leave in the order they came. Beyond IN_MEMORY entries
    blocks are written to an anonymous temporary file of the worker and read back when they leave; it goes with the queue."""

    def __init__(self, symbols: int):
        self.buckets: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.file = 0, IN_MEMORY, None

    def push(self, symbol: int, block: Block) -> None:
        n = len(block.pos)
        if self.held + n > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(block.pos.tobytes() + block.lcp.tobytes())
            self.buckets[symbol].append((at, n, block.origin))
        else:
            self.held += n
            self.buckets[symbol].append(block)

    def pop(self, symbol: int) -> list[Block]:
        out = []
        for b in self.buckets[symbol]:
            if isinstance(b, tuple):
                self.file.seek(b[0])
                data = np.frombuffer(self.file.read(8 * b[1]), dtype=np.int32)
                b = Block(data[: b[1]], data[b[1] :], b[2])
            else:
                self.held -= len(b.pos)
            out.append(b)
        self.buckets[symbol] = []
        return out

    def close(self) -> None:
        if self.file:
            self.file.close()


class Shard:
    """The text of a shard as symbols: 0 ends it, 1 stands between strings, bytes follow from 2."""

    def __init__(self, strings: list[bytes]):
        data = np.frombuffer(b"\0".join(strings) + b"\0\0", dtype=np.uint8)
        self.starts = np.cumsum([0, *[len(s) + 1 for s in strings]])
        # UTF-8 has no byte above 0xF4, so that two more symbols fit in a byte; other strings take two bytes a symbol.
        self.text = data + np.uint8(2) if data.max() < 0xFE else data.astype(np.uint16) + np.uint16(2)
        self.text[self.starts[1:] - 1] = 1
        self.text[-1] = 0
        n = len(self.text)
        # Where the symbol changes next: a suffix is smaller than its successor (S) if it then rises, and the distance is its run.
        change = np.flatnonzero(np.diff(self.text.astype(np.int32)))
        following = change[np.searchsorted(change, np.arange(n - 1))] if len(change) else np.zeros(0, np.int64)
        self.run = np.ones(n, dtype=np.int32)
        self.run[:-1] = following - np.arange(n - 1) + 1
        self.small = np.ones(n, dtype=bool)
        self.small[:-1] = self.text[following + 1] > self.text[:-1]
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1


def _joined(blocks: list[Block], shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """One batch of a symbol's blocks. Entries of different blocks were induced from suffixes of different first symbols (they share
    one symbol), or of the same first symbol in runs of different length or direction (they share the shorter run and one symbol)."""
    for before, after in zip(blocks, blocks[1:]):
        shared = 0
        if before.origin[0] == after.origin[0]:
            shared = min(before.origin[1], int(shard.run[after.pos[0] + 1]))
        after.lcp = after.lcp.copy()
        after.lcp[0] = 1 + shared
    if len(blocks) == 1:
        return blocks[0].pos, blocks[0].lcp
    return np.concatenate([b.pos for b in blocks]), np.concatenate([b.lcp for b in blocks])


def _induce(shard: Shard, queue: SpillQueue, symbol: int, pos: np.ndarray, lcp: np.ndarray, run: int, small: bool) -> Block | None:
    """Pushes the predecessors of a sorted batch that are of the wanted type, by their first symbol; those with the batch's own symbol are returned.

    The common prefix of two predecessors is one more than the least value between their successors."""
    before = pos - 1
    own = np.flatnonzero((pos > 0) & (shard.small[before] == small))
    if not len(own):
        return None
    symbols = shard.text[before[own]]
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    same = None
    for part in np.split(order, cuts):
        chosen = own[part]
        values = np.zeros(len(chosen), dtype=np.int32)
        if len(chosen) > 1:
            values[1:] = np.minimum.reduceat(lcp[: chosen[-1] + 1], chosen[:-1] + 1) + 1
        block = Block(before[chosen].astype(np.int32), values, (symbol, run))
        target = int(symbols[part[0]])
        if target == symbol:
            same = block
        else:
            queue.push(target, block)
    return same


def induced(shard: Shard, lms: np.ndarray, lms_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with the common prefix of each with the one before it, from the sorted LMS suffixes with theirs.

    Larger suffixes are induced in ascending, then smaller ones in descending order, a batch for each symbol and length of its run.
    """
    symbols = int(shard.text.max()) + 1
    first = shard.text[lms]
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    large, queue = SpillQueue(symbols), SpillQueue(symbols)
    for c in range(symbols):
        done: list[Block] = []
        blocks, run = queue.pop(c), 1
        while blocks:
            pos, lcp = _joined(blocks, shard)
            same = _induce(shard, queue, c, pos, lcp, run, False)
            lcp = lcp.copy()
            lcp[0] = run - 1 if done else 0
            done.append(Block(pos, lcp, (c, run)))
            blocks, run = [same] if same is not None else [], run + 1
        if bounds[c] < bounds[c + 1]:
            pos, lcp = lms[bounds[c] : bounds[c + 1]], lms_lcp[bounds[c] : bounds[c + 1]]
            _induce(shard, queue, c, pos, lcp, 1 << 30, False)
        for block in done:
            large.push(c, block)
    queue.close()

    out_pos, out_lcp, queue = [], [], SpillQueue(symbols)
    for c in range(symbols - 1, -1, -1):
        done = []
        blocks, run = queue.pop(c), 1
        while blocks:
            pos, lcp = _joined(blocks, shard)
            same = _induce(shard, queue, c, pos, lcp, run, True)
            lcp = lcp.copy()
            lcp[0] = run - 1 if done else 0
            done.append(Block(pos, lcp, (c, run)))
            blocks, run = [same] if same is not None else [], run + 1
        if c == 0:  # the end of the text is induced from nothing
            done = [Block(np.array([len(shard.text) - 1], np.int32), np.zeros(1, np.int32), (0, 1))]
        greater = large.pop(c)
        if greater:
            pos, lcp = np.concatenate([b.pos for b in greater]), np.concatenate([b.lcp for b in greater])
            turned = np.append(np.int32(0), lcp[:0:-1])
            _induce(shard, queue, c, pos[::-1], turned, 1 << 30, True)
        else:
            pos, lcp = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if done:
            down, values = np.concatenate([b.pos for b in done]), np.concatenate([b.lcp for b in done])
            up = np.append(np.int32(0), values[:0:-1])
            if len(pos):
                up[0] = min(int(shard.run[pos[-1]]), int(shard.run[down[-1]]))
            pos, lcp = np.concatenate([pos, down[::-1]]), np.concatenate([lcp, up])
        out_pos.append(pos)
        out_lcp.append(lcp)
    queue.close()
    large.close()
    return np.concatenate(out_pos[::-1]), np.concatenate(out_lcp[::-1])


def _order_of_names(names: np.ndarray, most: int) -> np.ndarray:
    """Suffix order of the reduced string by prefix doubling, right up to `most` names. Each round sorts only what is still tied."""
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    new = np.append(True, names[order][1:] != names[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of a group of ties
    while step < most and not new.all():
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of more than one
        who = order[tied]
        then = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        by = np.argsort(rank[who] * (n + 2) + then)
        who, then = who[by], then[by]
        order[tied] = who
        group = rank[who]
        new[tied] = np.append(True, (group[1:] != group[:-1]) | (then[1:] != then[:-1]))
        rank[who] = np.flatnonzero(new)[np.cumsum(new) - 1][tied]
        step *= 2
    return order


def _common(shard: Shard, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes, at most `most`, of suffixes that start at a and b."""
    out, open_ = np.zeros(len(a), dtype=np.int32), np.arange(len(a))
    n, size = len(shard.text), shard.text.itemsize
    padded = np.append(shard.text, np.zeros(8, shard.text.dtype))
    # Eight bytes from every position on, compared at once: the lowest bit that differs tells the first symbol that does.
    wide = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.data, strides=(size,))
    step = 8 // size
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        differ = wide[np.minimum(x, n - 1)] ^ wide[np.minimum(y, n - 1)]
        end = differ != 0
        lowest = differ & (~differ + np.uint64(1))
        symbols = (np.frexp(lowest.astype(np.float64))[1] - 1) // (8 * size)
        out[open_] += np.where(end, symbols, step).astype(np.int32)
        open_ = open_[~end & (out[open_] < most) & (np.maximum(x, y) + step < n)]
    return np.minimum(out, most)


def suffix_order(strings: list[bytes], most: int) -> tuple[Shard, np.ndarray, np.ndarray]:
    """(shard, positions in suffix order, common prefixes with the suffix before), prefixes right up to `most` symbols.

    Induction from LMS suffixes in order of their first symbol alone sorts the LMS substrings; equal ones get one name, and the string of
    names is sorted the same way one level down (by prefix doubling, its alphabet being large). Induction from the sorted LMS suffixes
    then gives all others.
    """
    shard = Shard(strings)
    lms = shard.lms
    rough = lms[np.argsort(shard.text[lms], kind="stable")].astype(np.int32)
    order, _ = induced(shard, rough, np.zeros(len(rough), np.int32))
    is_lms = np.zeros(len(shard.text), dtype=bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    index = np.zeros(len(shard.text), dtype=np.int32)
    index[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, len(shard.text) - 1)) + 1
    size = length[index[sorted_lms]]
    same = np.zeros(len(sorted_lms), dtype=bool)
    if len(sorted_lms) > 1:
        a, b = sorted_lms[:-1], sorted_lms[1:]
        like = np.flatnonzero(size[:-1] == size[1:])
        for lo in range(0, len(like), 1 << 19):
            k = like[lo : lo + (1 << 19)]
            limit = int(size[k].max())
            same[k + 1] = _common(shard, a[k].astype(np.int64), b[k].astype(np.int64), limit) >= size[k]
    names = np.zeros(len(lms), dtype=np.int64)
    names[index[sorted_lms]] = np.cumsum(~same)
    final = lms[_order_of_names(names, most)] if same.any() else sorted_lms
    lcp = np.zeros(len(final), dtype=np.int32)
    for lo in range(1, len(final), 1 << 19):
        k = np.arange(lo, min(lo + (1 << 19), len(final)))
        lcp[k] = _common(shard, final[k - 1].astype(np.int64), final[k].astype(np.int64), most)
    return shard, *induced(shard, final.astype(np.int32), lcp)
