"""A priority queue of messages that spills sorted runs to a file of the task's own."""

import heapq
import struct
import tempfile

#: Messages that a queue holds in memory.
KEPT_MESSAGES = 200_000


class SpillingQueue:
    """Messages (key, values) by rising key; equal keys are summed up.

    A key is a pair of integers, the values ``width`` integers.  When ``kept``
    messages wait in memory they go to disk as one sorted run; the runs are
    merged as they are read back.  Files are unnamed and go with the task.
    """

    def __init__(self, width, kept=KEPT_MESSAGES):
        self.record = struct.Struct(f"<{2 + width}q")
        self.kept, self.waiting, self.heap, self.runs, self.spilled = kept, {}, [], [], 0

    def push(self, key, values):
        found = self.waiting.get(key)
        if found is None:
            if len(self.waiting) >= self.kept:
                self.spill()
            self.waiting[key] = list(values)
            heapq.heappush(self.heap, key)
        else:
            for i, value in enumerate(values):
                found[i] += value

    def spill(self):
        file = tempfile.TemporaryFile()
        for key in sorted(self.waiting):
            file.write(self.record.pack(*key, *self.waiting[key]))
        file.seek(0)
        self.waiting.clear()
        self.heap.clear()
        run = self.read(file)
        heapq.heappush(self.runs, (*next(run), self.spilled, run))
        self.spilled += 1

    def read(self, file):
        size = self.record.size
        with file:
            while block := file.read(size * 4096):
                for found in self.record.iter_unpack(block):
                    yield found[:2], found[2:]

    def first(self):
        """The smallest key that waits, or None."""
        keys = [self.heap[0]] if self.heap else []
        keys += [self.runs[0][0]] if self.runs else []
        return min(keys, default=None)

    def pop(self, key):
        """The summed values of all messages of ``key``, or None; smaller keys must be gone."""
        found = None
        if self.heap and self.heap[0] == key:
            heapq.heappop(self.heap)
            found = self.waiting.pop(key)
        while self.runs and self.runs[0][0] == key:
            _, values, number, run = heapq.heappop(self.runs)
            found = list(values) if found is None else [x + y for x, y in zip(found, values)]
            after = next(run, None)
            if after is not None:
                heapq.heappush(self.runs, (*after, number, run))
        return found
