"""Byte-level BPE by prefix dynamic programming.

For every prefix of a match the BPE encoding is unique, so it is known by its last token alone: the table holds, for each
byte position, the last token of the prefix ending there. A token t may end a prefix when t is a suffix of it and the pair
(last token before t, t) stands, that is, merging the two tokens' bytes gives back just those two. The table makes
appending exact (it only grows) and an edit costs the bytes up to where old and new table agree again.

``encode_decode(df)`` adds to every row n_tokens, ids_sha256 and decoded_sha256 of its text. Null and empty texts have no
ids. Very long texts go through piece by piece. Repeated rows are each encoded. Columns of df stay unless they clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.units import Pieces, held


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class PrefixTable:
    """The last token of each prefix of one match, extended and edited in place."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        self.bpe.extend(bytes(self.data), self.last, at)

    def splice(self, at: int, removed: int, added: bytes) -> int:
        """Replace data[at:at+removed]; returns how many positions were computed anew before old and new table met."""
        old, old_end = self.last, at + removed
        self.data[at:old_end] = added
        data, self.last, n, same = bytes(self.data), old[:at], 0, 0
        shift = len(added) - removed
        while len(self.last) < len(data):
            self.bpe.extend(data, self.last, len(self.last), len(self.last) + 1)
            n += 1
            p = len(self.last)
            same = same + 1 if p >= at + len(added) + self.bpe.longest and old[p - 1 - shift] == self.last[-1] else 0
            if same >= self.bpe.longest:  # every token that can start later looks back at most this far
                self.last += old[p - shift :]
                break
        return n

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.bpe.token[self.last[at - 1]])
        return out[::-1]


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends: dict = {}  # tokens by their bytes from the last to the first; at None the rank
        for t, r in ranks.items():
            node = self.ends
            for b in reversed(t):
                node = node.setdefault(b, {})
            node[None] = r
        self.stands: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE on a few bytes: the pair of lowest rank merges first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def extend(self, data: bytes, last: list[int], at: int, to: int | None = None) -> None:
        """Fill last for the positions from at on; last holds those before."""
        stands, own, token, ends = self.stands, self.own, self.token, self.ends
        for i in range(at, len(data) if to is None else to):
            node, j, found = ends, i, []
            while j >= 0 and (node := node.get(data[j])) is not None:
                if None in node:
                    found.append((j, node[None]))
                j -= 1
            for j, t in reversed(found):
                if j == 0:
                    if (ok := own.get(t)) is None:
                        ok = own[t] = self.merged(token[t]) == [t]
                else:
                    pair = (last[j - 1], t)
                    if (ok := stands.get(pair)) is None:
                        ok = stands[pair] = self.merged(token[pair[0]] + token[t]) == [*pair]
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def encode(self, match: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = match.encode()
        if (r := self.ranks.get(data)) is not None:
            return [r]
        last: list[int] = []
        self.extend(data, last, 0)
        out, at, token = [], len(data), self.token
        while at:
            out.append(last[at - 1])
            at -= len(token[last[at - 1]])
        return out[::-1]


def codec(path: str, pattern: str) -> tuple[Pieces, dict[str, bytes]]:
    """Of this worker: texts to decimal ids joined by spaces, and bytes by decimal id."""

    def make():
        bpe = PrefixBPE(load_ranks(path))
        return Pieces(pattern, lambda m: " ".join(map(str, bpe.encode(m))), " ".join), {str(r): t for t, r in bpe.ranks.items()}

    return held(("bpe", path), make)


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df's columns but the text, then n_tokens long, ids_sha256 and decoded_sha256; a map over rows, without a shuffle."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in df.columns if c != text and c not in new]
    schema = df.select(keep).schema
    for name, kind in zip(new, ("long", "string", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = codec(path, pattern)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(len(keep)).to_pylist():
                ids = " ".join([x for x in pieces(t) if x]) if t else ""
                listed = ids.split(" ") if ids else []
                counts.append(len(listed))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(known.__getitem__, listed))).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*keep, *new])

    return df.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)
