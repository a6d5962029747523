"""Token ids of whole texts by the tokenizers library, each distinct chunk of a slice of texts encoded once.

Both vocabularies split a text before the merges, and never join what follows a run of ASCII white space with what
stands before it, nor a mark of sentences with an ASCII letter before it. So the ids of a text are those of its chunks: a
run of white space and the other characters up to the next one, less the marks after a word. Chunks are found by NumPy in the bytes of a column and told apart by Arrow's dictionary encoding. Texts with
white space outside ASCII, or controls that some libraries count as such, are encoded whole. Strings of special tokens
inside a text get what the library gives by default, their own id.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20  # texts whose chunks are looked up together; one longer text is a slice of its own
MEMO_BYTES = 128 << 20  # of chunks that a worker remembers between slices, by a rough count
GROUP = 50  # new chunks that are encoded in one text, with a special token between them
SEPARATOR = "<|endoftext|>"  # a special token of both vocabularies: what stands around one is encoded apart
_ENTRY = 160  # bytes of a remembered chunk besides its own

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# White space outside ASCII and the separators U+001C to U+001F.
_ODD = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_IS_LETTER, _IS_MARK = np.zeros(256, bool), np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_MARK[list(b".,;:?!")] = True


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        if self.separator is None:
            raise ValueError(f"the tokenizer has no {SEPARATOR}")
        self.memo: dict[bytes, bytes] = {}
        self.memo_bytes = 0

    def _library(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        alone = [i for i, c in enumerate(chunks) if b"<|" in c or len(c) > 1000]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        apart = set(alone)
        joint = [i for i in range(len(chunks)) if i not in apart] if apart else range(len(chunks))
        between = SEPARATOR.encode()
        groups = [joint[i : i + GROUP] for i in range(0, len(joint), GROUP)]
        texts = [between.join([chunks[i] for i in g]).decode() for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids, begin = np.array(e.ids, "<u4"), 0
            data = ids.tobytes()
            for i, end in zip(group, [*(4 * np.flatnonzero(ids == self.separator)).tolist(), len(data)]):
                out[i] = data[begin:end]
                begin = end + 4
        return out

    def _chunks(self, distinct: list[bytes], uses: np.ndarray) -> list[bytes]:
        """Ids of each chunk; those that a slice has several times are remembered."""
        out = [self.memo.get(c) for c in distinct]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(missing, self._library([distinct[i] for i in missing])):
            out[i] = ids
            if uses[i] > 1:
                self.memo[distinct[i]] = ids
                self.memo_bytes += _ENTRY + len(distinct[i]) + len(ids)
        if self.memo_bytes > MEMO_BYTES:  # the older half goes
            for old in list(self.memo)[: len(self.memo) // 2]:
                self.memo_bytes -= _ENTRY + len(old) + len(self.memo.pop(old))
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: large_binary without nulls. All ids, and how many each text has."""
        count = len(texts)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64, count + 1, 8 * texts.offset)
        size = int(ends[-1] - ends[0])
        if not size:
            return np.zeros(0, "<u4"), np.zeros(count, np.int64)
        raw, ends = np.frombuffer(data, np.uint8, size, int(ends[0])), ends - ends[0]
        begins_text = ends[:-1][ends[:-1] < ends[1:]]
        whole = pc.match_substring_regex(texts.cast(pa.large_string()), _ODD).to_numpy(zero_copy_only=False)
        space = _IS_SPACE[raw]
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[1:] |= _IS_MARK[raw[1:]] & _IS_LETTER[raw[:-1]]
        if whole.any():  # a text encoded whole is one chunk
            starts &= ~np.repeat(whole, np.diff(ends))
        starts[begins_text] = True
        cuts = np.append(np.flatnonzero(starts), size)
        column = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        which, distinct = column.indices.to_numpy(), column.dictionary.to_pylist()
        known = self._chunks(distinct, np.bincount(which, minlength=len(distinct)))
        kind = np.int32 if size < 1 << 30 else np.int64  # there are fewer ids than bytes
        lengths = np.fromiter(map(len, known), kind, len(known)) // 4
        first = np.cumsum(lengths, dtype=kind) - lengths
        n = lengths[which]
        ends_chunk = np.cumsum(n, dtype=kind)
        places = np.repeat(first[which] - (ends_chunk - n), n)
        places += np.arange(len(places), dtype=kind)
        ids = np.frombuffer(b"".join(known), "<u4")[places]
        before = np.concatenate([[0], ends_chunk])[np.searchsorted(cuts, ends)]
        return ids, np.diff(before)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of a string column: the place of the first text, all ids in order, how many each text has. Null
        counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield begin, *self._slice(texts.slice(begin, end - begin))
            begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null as empty."""
        out = []
        for _, ids, counts in self.encode_column(pa.array(texts, pa.large_string())):
            out += [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(path)
