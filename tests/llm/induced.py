"""A prototype of external induced suffix sorting, to measure what it costs: python tests/llm/induced.py [bytes]

Suffix tuples (character, kind, order, position) go through a priority queue that spills sorted runs to disk: one scan
induces the L-suffixes from the sorted S*-suffixes, one the S-suffixes from those; S*-substrings are named by sorting
and sorted by recursion. Common-prefix values are left out, which would make every tuple longer.
"""

from __future__ import annotations

import heapq
import resource
import struct
import sys
import tempfile
import time

RECORD = struct.Struct("<qqqq")


class Queue:
    """A smallest-first queue of tuples of four numbers with at most `most` of them in memory."""

    def __init__(self, most: int):
        self.most, self.heap, self.heads, self.written = most, [], [], 0

    def push(self, item: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:  # the larger half becomes a run; the smaller is needed soon
            self.heap.sort()
            half = len(self.heap) // 2
            run = tempfile.TemporaryFile()
            for x in self.heap[half:]:
                run.write(RECORD.pack(*x))
            self.written += RECORD.size * (len(self.heap) - half)
            run.seek(0)
            self.heap = self.heap[:half]
            self._next(len(self.heads), run)

    def _next(self, name: int, run) -> None:
        raw = run.read(RECORD.size)
        if raw:
            heapq.heappush(self.heads, (RECORD.unpack(raw), name, run))

    def pop(self) -> tuple[int, int, int, int] | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, name, run = heapq.heappop(self.heads)
            self._next(name, run)
            return item
        return heapq.heappop(self.heap) if self.heap else None


def suffixes(text: list[int], most: int, told: dict[str, int]) -> list[int]:
    """Begins of the suffixes of a text of positive numbers in their order."""
    n = len(text)
    t = [*text, 0]
    small = [False] * (n + 1)  # S-suffixes: those less than the next one
    small[n] = True
    for i in range(n - 1, -1, -1):
        small[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and small[i + 1])
    stars = [i for i in range(1, n + 1) if small[i] and not small[i - 1]]
    pieces = {i: tuple(t[i : j + 1]) for i, j in zip(stars, [*stars[1:], n], strict=True)}
    # Of two pieces of which one begins the other, the longer goes on with an L-suffix, which comes first.
    names = {p: k + 1 for k, p in enumerate(sorted(set(pieces.values()), key=lambda p: (*p, float("inf"))))}
    if len(names) < len(stars):
        order = [stars[k] for k in suffixes([names[pieces[i]] for i in stars], most, told)]
    else:
        order = sorted(stars, key=lambda i: names[pieces[i]])
    queue, count = Queue(most), 0
    for k, i in enumerate(order):
        queue.push((t[i], 1, k, i))
    large = []
    while (x := queue.pop()) is not None:
        c, star, _, i = x
        count += 1
        if not star:
            large.append(i)
        if i and not small[i - 1]:
            queue.push((t[i - 1], 0, count, i - 1))
    told["written"] += queue.written
    queue, count, out = Queue(most), 0, []
    queue.push((0, 1, -1, n))
    for k, i in enumerate(reversed(large)):
        queue.push((-t[i], 1, k, i))
    while (x := queue.pop()) is not None:
        i = x[3]
        count += 1
        out.append(i)
        if i and small[i - 1]:
            queue.push((-t[i - 1], 0, count, i - 1))
    told["written"] += queue.written
    out.reverse()
    return [i for i in out if i < n]


def main() -> None:
    import pyarrow.parquet as pq

    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    data = "".join(x or "" for x in rows).encode()[:n]
    began, told = time.process_time(), {"written": 0}
    got = suffixes([b + 1 for b in data], 100_000, told)
    spent = time.process_time() - began
    assert len(got) == len(data) and all(data[a : a + 200] <= data[b : b + 200] for a, b in zip(got[:5000], got[1:5001], strict=False))
    print(f"{n} bytes: {spent:.1f} CPU s, {1e6 * spent / n:.1f} us a byte, {told['written'] / n:.1f} bytes written to disk for each, {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024} MB")


if __name__ == "__main__":
    main()
