"""Token ids of whole columns of texts by a public byte-level BPE with word ends.

The vocabulary's own pattern cuts a normalised text into runs of letters, single digits, runs of
other signs and a few contractions; no token crosses a cut. NumPy finds the cuts of a whole batch
of texts at once, Arrow names the distinct runs, the tokenizers library encodes each run that the
process has not met yet, and NumPy gathers the ids of all texts. Texts with characters beyond
ASCII and the letters of Latin-1, whose normal form needs more than lower case, go through the
tokenizers library whole, as do those that spell a special token, and all texts where the vocabulary
file asks for other normalisation, cuts or added tokens than those.
"""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
#: Runs that a worker keeps; the cache starts anew beyond it, which changes no id.
MOST_RUNS = 300_000

SPACE, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8
#: What a vocabulary file says where its texts can be cut into runs as here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_into_runs(whole) -> bool:
    """Whether a tokenizer has the normaliser, cuts, word ends and added tokens that runs rest on; its large parts are not copied."""
    shown = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    model, first, *rest = whole.model, *(shown(whole.pre_tokenizer).get("pretokenizers") or [{}])
    return (
        shown(whole.normalizer).get("normalizers") == NORMALIZERS
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": CUTS}, "Removed", True)
        and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and (type(model).__name__, getattr(model, "end_of_word_suffix", None), getattr(model, "dropout", None)) == ("BPE", "</w>", None)
        and not whole.truncation
        and all(t.content.startswith("<|") and not (t.normalized or t.single_word or t.lstrip or t.rstrip) for t in whole.get_added_tokens_decoder().values())
    )


def give_back() -> None:
    """Return to the system what a worker's allocators hold without use, as a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def tidy(rows: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


class RunBpe:
    """Encoder of one process; ``of`` returns the process's encoder of a vocabulary file."""

    _made: dict[str, "RunBpe"] = {}

    @classmethod
    def of(cls, path: str) -> "RunBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.by_runs = _cuts_into_runs(self.whole)
        self.by_run = Tokenizer(self.whole.model)  # the same model, without added tokens
        self.by_run.normalizer = normalizers.Sequence([])
        self.by_run.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.whole.get_vocab()
        self.ends_run = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends_run[i] = piece.endswith("</w>")
        self.runs: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        """Put the ids of runs that are not known yet into ``runs``; white space has none."""
        signs = [r for r in new if not r.isspace()]
        self.runs.update((r, b"") for r in new if r.isspace())
        if not signs:
            return
        joined = b" ".join(signs).decode()
        ids = np.array(self.by_run.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends_run[ids]) + 1) * 4
        if len(ends) != len(signs):
            raise ValueError("the vocabulary has no word ends")
        raw, at = ids.tobytes(), 0
        for r, end in zip(signs, ends.tolist()):
            self.runs[r], at = raw[at:end], end

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) and, with one more entry than texts, where each text's begin."""
        _, offsets, data = texts.buffers()
        first = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]] if data else np.zeros(0, np.uint8)
        first = first - first[0]
        if not self.by_runs:
            empty = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
            return self._replaced(texts, np.arange(len(texts)), *empty) if len(texts) else empty
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        low = LOWER[raw]
        after = np.flatnonzero(raw[:-1] == LEAD) + 1
        tails = raw[after]
        low[after] += ((tails <= 0x9E) & (tails != 0x97)).astype(np.uint8) * 32
        # texts that are not plain: bytes beyond ASCII and Latin-1's letters, or a special token's start
        odd = raw >= 128
        odd[after] = False
        odd[after - 1] = False
        odd[after[(tails == 0x97) | (tails == 0xB7)]] = True
        odd |= (raw >= 0x1C) & (raw <= 0x1F) | (raw == 0x7F)
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd_texts = np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1)
        kind = KIND[low]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[first] = True
        self._contractions(low, kind, cut, first)
        at = np.flatnonzero(cut)
        named = pa.Array.from_buffers(
            pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(low)]
        ).dictionary_encode()
        names = _as_bytes(named.dictionary)
        if len(self.runs) > MOST_RUNS:
            self.runs.clear()
        new = [r for r in names if r not in self.runs]
        if len(odd_texts):  # their runs may not be text, and are not used
            new = self._usable(new)
        self._learn(new)
        parts = [self.runs.get(r, b"") for r in names]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), "<u4")
        which = named.indices.to_numpy()
        n = size[which]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        where = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n)
        where += np.arange(len(where))
        ids, starts = flat[where], ends[np.searchsorted(at, first)]
        return self._replaced(texts, odd_texts, ids, starts) if len(odd_texts) else (ids, starts)

    @staticmethod
    def _usable(runs: list[bytes]) -> list[bytes]:
        """Runs that are text: a cut inside a character of an odd text may leave others."""
        good = []
        for r in runs:
            try:
                if not any(c.isspace() for c in r.decode()) or r.isspace():
                    good.append(r)
            except UnicodeDecodeError:
                pass
        return good

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, cut: np.ndarray, first: np.ndarray) -> None:
        """Move the cut behind a lone apostrophe to behind 's, 't, 'm, 'd, 're, 've or 'll."""
        q = np.flatnonzero(low == ord("'"))
        q = q[q + 1 < len(low)]
        q = q[cut[q] & cut[q + 1] & (kind[q + 1] == LETTER)]
        q = q[~np.isin(q + 1, first)]
        if not len(q):
            return
        one = low[q + 1]
        two = low[np.minimum(q + 2, len(low) - 1)]
        joined = (q + 2 < len(low)) & ~cut[np.minimum(q + 2, len(low))]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = joined & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for which, length in ((short, 2), (long, 3)):
            cut[q[which] + 1] = False
            cut[q[which] + length] = True

    def _replaced(self, texts, which: np.ndarray, ids: np.ndarray, starts: np.ndarray):
        """Put what the library makes of some texts whole in the place of their ids."""
        parts, at = [], 0
        sizes = np.diff(starts)
        whole = self.whole.encode_batch_fast([texts[int(i)].as_py() for i in which], add_special_tokens=False)
        for i, e in zip(which.tolist(), whole):
            parts += [ids[at : starts[i]], np.array(e.ids, np.uint32)]
            sizes[i] = len(e.ids)
            at = starts[i + 1]
        new = np.zeros_like(starts)
        np.cumsum(sizes, out=new[1:])
        return np.concatenate([*parts, ids[at:]]), new


def _as_bytes(names: pa.LargeBinaryArray) -> list[bytes]:
    _, offsets, data = names.buffers()
    at, raw = np.frombuffer(offsets, np.int64, len(names) + 1).tolist(), data.to_pybytes()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def steps(texts: pa.Array) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """Cut a column into runs of about STEP_BYTES; yields each run's first row and its texts, null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + STEP_BYTES, "right")))
        yield at, texts.slice(at, end - at)
        at = end
