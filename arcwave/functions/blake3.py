"""BLAKE3 (public specification) with numpy: all chunks of an input are compressed side by side."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED, CONTEXT, MATERIAL = 1, 2, 4, 8, 16, 32, 64
CHUNK, BLOCK = 1024, 64
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The first 8 words of the output for columns of inputs: cv (8, n), words (16, n)."""
    n = cv.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    v[8:12] = np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), size, flags
    m = words
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for r, (x, y) in zip((2 * k, 2 * k + 1), ((16, 12), (8, 7)), strict=True):
                v[a] = v[a] + v[b] + m[r]
                v[d] = _turn(v[d] ^ v[a], x)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], y)
        if turn < 6:
            m = m[list(PERMUTATION)]
    return v[:8] ^ v[8:]


def _chunk(data: bytes, key: np.ndarray, first: int, flags: int, root: bool) -> np.ndarray:
    """Chaining values (8, n) of n chunks that are all whole, or of one chunk of any size."""
    n = max(1, len(data) // CHUNK)
    size = len(data) if n == 1 else CHUNK
    blocks = max(1, -(-size // BLOCK))
    padded = np.frombuffer(data.ljust(n * blocks * BLOCK, b"\0"), "<u4").reshape(n, blocks, 16)
    cv = np.repeat(key[:, None], n, axis=1)
    counter = np.arange(first, first + n, dtype=np.uint64)
    for k in range(blocks):
        last = k == blocks - 1
        mark = flags | (CHUNK_START if k == 0 else 0) | (CHUNK_END if last else 0) | (ROOT if last and root else 0)
        cv = _compress(cv, np.ascontiguousarray(padded[:, k].T), counter, np.full(n, size - k * BLOCK if last else BLOCK, np.uint32), np.full(n, mark, np.uint32))
    return cv


def _merged(cvs: np.ndarray, key: np.ndarray, flags: int, root: bool) -> np.ndarray:
    """The chaining value (8, 1) over neighbours (8, n): each level pairs them and carries an odd last one."""
    while cvs.shape[1] > 1:
        n = cvs.shape[1] // 2
        words = np.concatenate([cvs[:, 0 : 2 * n : 2], cvs[:, 1 : 2 * n : 2]])
        mark = flags | PARENT | (ROOT if root and cvs.shape[1] == 2 else 0)
        up = _compress(np.repeat(key[:, None], n, axis=1), words, np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), np.full(n, mark, np.uint32))
        cvs = np.concatenate([up, cvs[:, 2 * n :]], axis=1)
    return cvs


def _subtree(data: bytes, key: np.ndarray, first: int, flags: int, root: bool) -> np.ndarray:
    """The chaining value of ``data``, which starts at chunk ``first`` of its message."""
    whole = (len(data) - 1) // CHUNK if data else 0  # the last chunk, also a whole one, stands alone
    if not whole:
        return _chunk(data, key, first, flags, root)
    cvs = [_chunk(data[: whole * CHUNK], key, first, flags, False), _chunk(data[whole * CHUNK :], key, first + whole, flags, False)]
    return _merged(np.concatenate(cvs, axis=1), key, flags, root)


def _bytes(cv: np.ndarray) -> bytes:
    return cv[:, 0].astype("<u4").tobytes()


def _hash(data: bytes, key: np.ndarray, flags: int) -> bytes:
    return _bytes(_subtree(data, key, 0, flags, True))


def digest(data: bytes) -> bytes:
    return _hash(data, np.array(IV, np.uint32), 0)


def context_key(context: str) -> np.ndarray:
    return np.frombuffer(_hash(context.encode(), np.array(IV, np.uint32), CONTEXT), "<u4")


def derive_key(context: str, material: bytes) -> bytes:
    return _hash(material, context_key(context), MATERIAL)


def material_part(part: bytes, key: np.ndarray, first: int, alone: bool) -> bytes:
    """The value of one aligned part of the material, from chunk ``first``; parts but the last have one power of two of chunks. ``alone``: it is all."""
    return _bytes(_subtree(part, key, first, MATERIAL, alone))


def merged_parts(values: list[bytes], key: np.ndarray, top: bool) -> bytes:
    """The value over neighbouring parts, one power of two of them except at the end; with ``top``, the derived key."""
    return _bytes(_merged(np.frombuffer(b"".join(values), "<u4").reshape(-1, 8).T.astype(np.uint32), key, MATERIAL, top))
