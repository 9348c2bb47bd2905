"""The first 32 bits of MD5 of many byte strings that begin alike, worked out side by side in numpy."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

_TURNS = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
_ADDED = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_WORD = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ALL = 0xFFFFFFFF
_ADDENDS, _LEFT, _RIGHT = ([np.array(x, np.uint32) for x in y] for y in (_ADDED, _TURNS, [32 - t for t in _TURNS]))


#: Ends below which one hash after the other is faster.
FEW = 1000


class Ends:
    """Ends of equal length, each followed by ``tail``; :meth:`heads` gives the hashes' beginnings behind any common start."""

    def __init__(self, ends: list[bytes], tail: bytes):
        self.n, self.size, self.few = len(ends), len(ends[0]) + len(tail), [e + tail for e in ends] if len(ends) < FEW else None
        self.bytes = np.frombuffer(b"".join(e + tail + b"\x80" for e in ends), np.uint8).reshape(self.n, self.size + 1)
        self.shifted: dict[int, list] = {}
        self.room = [np.empty(self.n, np.uint32) for _ in range(6)]

    def _words(self, shift: int) -> list:
        """The words behind ``shift`` bytes of 0; those that all have alike are numbers."""
        if shift not in self.shifted:
            wide = np.zeros((self.n, -(-(shift + self.size + 1) // 4) * 4), np.uint8)
            wide[:, shift : shift + self.size + 1] = self.bytes
            words = np.ascontiguousarray(wide.view("<u4").T)
            self.shifted[shift] = [int(w[0]) if (w == w[0]).all() else w.astype(np.uint32) for w in words]
        return self.shifted[shift]

    def heads(self, start: bytes) -> np.ndarray:
        """Of the MD5 of ``start``, each end and the tail the first four bytes, as the number that their hexadecimal digits say."""
        if self.few is not None:
            return np.array([int.from_bytes(md5(start + e).digest()[:4]) for e in self.few], np.uint32)
        whole, shift = divmod(len(start), 4)
        size = len(start) + self.size
        words: list = [0] * (16 * ((size + 8) // 64 + 1))
        words[:whole] = np.frombuffer(start[: 4 * whole], "<u4").tolist()
        for k, word in enumerate(self._words(shift)):
            words[whole + k] = word
        if shift:
            first = int.from_bytes(start[4 * whole :], "little")
            words[whole] = words[whole] | first if isinstance(words[whole], int) else words[whole] | np.uint32(first)
        words[-2], words[-1] = 8 * size & _ALL, 8 * size >> 32
        state: tuple = _START
        for at in range(0, len(words), 16):
            last = at + 16 == len(words)
            out = self._block(state, words[at : at + 16], 61 if last else 64)
            if last:
                break
            # sums of arrays are new ones, so the room is free again
            state = tuple((x + y) & _ALL if isinstance(x, int) and isinstance(y, int) else np.asarray(x, np.uint32) + np.asarray(y, np.uint32) for x, y in zip(state, out, strict=True))
        head = np.asarray(state[0], np.uint32) + np.asarray(out[1], np.uint32)
        return np.broadcast_to(head, self.n).byteswap()

    def _block(self, state: tuple, words: list, steps: int) -> tuple:
        """The words of the state after so many steps; the one that came last is the second."""
        a, b, c, d = state
        free, spare = self.room[:5], self.room[5]
        add, xor, both, either = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or
        k = 0
        while k < steps and isinstance(b, int) and all(isinstance(x, int) for x in (a, c, d, words[_WORD[k]])):  # as long as all have the same
            mixed = (d ^ b & (c ^ d), c ^ d & (b ^ c), b ^ c ^ d, c ^ (b | ~d & _ALL))[k // 16]
            mixed = mixed + a + words[_WORD[k]] + _ADDED[k] & _ALL
            a, b, c, d, k = d, ((mixed << _TURNS[k] | mixed >> 32 - _TURNS[k]) + b) & _ALL, b, c, k + 1
        own: list = []  # which of the four are arrays of the room, oldest first
        a, b, c, d = (np.array(x, np.uint32) if isinstance(x, int) else x for x in (a, b, c, d))
        for k in range(k, steps):
            word, t = words[_WORD[k]], free.pop()
            if k < 16:
                xor(c, d, t)
                both(t, b, t)
                xor(t, d, t)
            elif k < 32:
                xor(b, c, t)
                both(t, d, t)
                xor(t, c, t)
            elif k < 48:
                xor(b, c, t)
                xor(t, d, t)
            else:
                np.invert(d, t)
                either(t, b, t)
                xor(t, c, t)
            add(t, a, t)
            if isinstance(word, int):
                add(t, np.array(word + _ADDED[k] & _ALL, np.uint32), t)
            else:
                add(t, word, t)
                add(t, _ADDENDS[k], t)
            np.left_shift(t, _LEFT[k], spare)
            np.right_shift(t, _RIGHT[k], t)
            either(t, spare, t)
            add(t, b, t)
            own.append(t)
            if len(own) > 4:  # it was a
                free.append(own.pop(0))
            a, b, c, d = d, t, b, c
        return a, b, c, d
