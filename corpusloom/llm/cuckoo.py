"""A cuckoo filter over live digests, with the digests kept beside it in buckets."""

from __future__ import annotations

from array import array

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Maps digests to values. The filter answers most misses; a hit is verified against the bucketed digests.

    The filter holds 16-bit fingerprints, four to a bucket, each in one of two buckets. `insert`
    that finds no room after MAX_KICKS moves doubles the filter and fills it again from the stored
    digests, so nothing is ever lost. `delete` frees the slot of a live digest. The digests live in
    buckets named by their first bytes, and a filter hit counts only if the whole digest and its
    witness (the length of the text) are there.
    """

    def __init__(self, buckets: int = 1024):
        self.content: dict[int, list] = {}
        self.size = 0
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _put(self, bucket: int, mark: int) -> bool:
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[k]:
                self.slots[k] = mark
                return True
        return False

    def _add(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        if self._put(one, mark) or self._put(two, mark):
            return True
        bucket = two
        for kick in range(MAX_KICKS):
            k = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._add(entry[0]) for held in self.content.values() for entry in held):
                return

    def maybe(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        s, a, b = self.slots, one * SLOTS, two * SLOTS
        return mark in s[a : a + SLOTS] or mark in s[b : b + SLOTS]

    def find(self, digest: bytes, witness: int):
        """The value of a live digest, or None."""
        if self.maybe(digest):
            for entry in self.content.get(int.from_bytes(digest[10:14], "little"), ()):
                if entry[0] == digest and entry[1] == witness:
                    return entry[2]
        return None

    def insert(self, digest: bytes, witness: int, value) -> None:
        self.content.setdefault(int.from_bytes(digest[10:14], "little"), []).append((digest, witness, value))
        self.size += 1
        if self.size > (self.mask + 1) * SLOTS * 0.94 or not self._add(digest):
            self._grow()

    def delete(self, digest: bytes, witness: int) -> bool:
        """Removes a live digest; False if it isn't one, and then nothing changes."""
        key = int.from_bytes(digest[10:14], "little")
        held = self.content.get(key, [])
        for n, entry in enumerate(held):
            if entry[0] == digest and entry[1] == witness:
                held.pop(n)
                if not held:
                    del self.content[key]
                self.size -= 1
                mark, one, two = self._places(digest)
                for bucket in (one, two):
                    for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                        if self.slots[k] == mark:
                            self.slots[k] = 0
                            return True
                return True
        return False

    def entries(self):
        for held in self.content.values():
            yield from held
