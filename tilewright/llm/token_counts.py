"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers do the work, both run over many places of a batch at once.

The splitter reads classes of code points and marks where pretokens start. A batch is one
stream cut into chunks of equal length. Each chunk is read from every state at once, which
gives its state map; the maps compose in a parallel prefix scan, so each chunk learns its
first state, and a second reading marks the starts.

The counter reads the bytes of a pretoken. Its states stand for what the rest of the word can
still depend on: the longest suffix that begins some token, with the last token and the number
of tokens of each prefix inside that suffix. Each transition is annotated with the number of
tokens it adds to the count (it may take some back). States and transitions are compiled when
first met; when the table is full, the half of the states that was met longest ago is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.token_output import byte_symbols

#: Code points in a chunk of the splitter, and about as many bytes in a lane of the counter.
CHUNK = 512
#: Characters that one pass over a batch takes; longer texts make a pass of their own.
PASS_CHARS = 1_000_000
#: States of the counter (64 int32 columns, 64 int8 ones and a key each) above which a pass begins with half of them. A pass adds one a byte at most.
MAX_STATES = 150_000
#: Pairs of tokens remembered, above which a pass begins without them.
MAX_PAIRS = 300_000

# Classes of code points. The contractions 's 't 're 've 'm 'll 'd of the split pattern.
_ONE, _R, _V, _L, _E, _LETTER, _NUMBER, _SPACE, _WHITE, _APOS, _OTHER, _END = range(12)
# States: start of text, letters, numbers, others, an apostrophe that begins a pretoken, the
# same and r, v, l after it, a whole contraction, one space, one other white, and longer white
# ending in a space or in another white.
_S, _LE, _NU, _OT, _A, _AR, _AV, _AL, _C, _P, _Q, _RUN_SPACE, _RUN_WHITE = range(13)
STATES = 13


def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, start before this code point, start before the previous one, by state and class."""
    nxt = np.zeros((STATES, 12), np.uint8)
    here, before = np.zeros((STATES, 12), bool), np.zeros((STATES, 12), bool)
    letters = (_ONE, _R, _V, _L, _E, _LETTER)
    fresh = {c: _LE for c in letters} | {_NUMBER: _NU, _OTHER: _OT, _APOS: _A, _SPACE: _P, _WHITE: _Q, _END: _S}
    for s in range(STATES):
        for c in range(12):
            nxt[s, c], here[s, c] = fresh[c], True
    for c in letters:
        nxt[_LE, c], here[_LE, c] = _LE, False
    nxt[_NU, _NUMBER], here[_NU, _NUMBER] = _NU, False
    for s in (_OT, _A):
        for c in (_OTHER, _APOS):
            nxt[s, c], here[s, c] = _OT, False
    nxt[_A, _ONE], here[_A, _ONE] = _C, False
    for c, s in ((_R, _AR), (_V, _AV), (_L, _AL)):
        nxt[_A, c], here[_A, c] = s, False
    for s, last in ((_AR, _E), (_AV, _E), (_AL, _L)):
        for c in range(12):  # the contraction fails: the letter began a word of its own
            before[s, c] = True
            if c in letters:
                nxt[s, c], here[s, c] = _LE, False
        nxt[s, last], before[s, last] = _C, False
    for s in (_P, _RUN_SPACE):  # a last space joins what follows
        for c, to in [(c, _LE) for c in letters] + [(_NUMBER, _NU), (_OTHER, _OT), (_APOS, _OT)]:
            nxt[s, c], here[s, c] = to, False
            before[s, c] = s == _RUN_SPACE
    for c in (*letters, _NUMBER, _OTHER, _APOS):
        before[_RUN_WHITE, c] = True
    for s in (_P, _Q, _RUN_SPACE, _RUN_WHITE):
        nxt[s, _SPACE], nxt[s, _WHITE] = _RUN_SPACE, _RUN_WHITE
        here[s, _SPACE] = here[s, _WHITE] = False
    return nxt, here, before


def code_point_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties that the split pattern names."""
    import regex

    table = np.full(0x110001, _OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _WHITE)):
        for m in regex.finditer(pattern, text):
            table[[ord(c) for c in m.group()]] = kind
    for chars, kind in (("stmd", _ONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E), (" ", _SPACE), ("'", _APOS)):
        table[[ord(c) for c in chars]] = kind
    table[0x110000] = _END
    return table


class Counter:
    """The compiled tokenizer of a file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        tidy = not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])
        if model["type"] != "BPE" or not plain or not tidy or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.classes = code_point_classes()
        self.next, self.here, self.before = _splitter()
        to_byte = byte_symbols()
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.tokens: set[bytes] = {bytes([b]) for b in range(256)}
        for i, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = bytes(to_byte[c] for c in left), bytes(to_byte[c] for c in right)
            self.rank[pair] = i
            self.tokens.add(pair[0] + pair[1])
        self.longest = max(map(len, self.tokens))
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self._pair_memo: dict[tuple[bytes, bytes], bool] = {}
        self._token_memo: dict[bytes, bool] = {}
        self.column = np.full(256, -1, np.int16)
        self.columns = 64
        self.used = 0
        self.key: list[tuple] = [(b"", (), ())]
        self.state_of: dict[tuple, int] = {self.key[0]: 0}
        self.to = np.full((4096, self.columns), -1, np.int32)
        self.adds = np.zeros((4096, self.columns), np.int8)
        self.passes = 0
        self.met = np.zeros(4096, np.int64)  # the last pass that met a state

    def _cut_back(self) -> None:
        """Drop the states met longest ago, so that half the table stays; transitions into them are compiled again when met."""
        n = len(self.key)
        latest = np.argsort(-self.met[1:n], kind="stable")[: max(0, MAX_STATES // 2 - 1)] + 1
        kept = np.concatenate([[0], np.sort(latest)])
        place = np.full(n + 1, -1, np.int32)  # the last one is for transitions that aren't compiled
        place[kept] = np.arange(len(kept))
        self.to, self.adds, self.met = place[self.to[kept]], self.adds[kept], self.met[kept]
        self.key = [self.key[i] for i in kept.tolist()]
        self.state_of = {k: i for i, k in enumerate(self.key)}

    # -- byte pair merges -------------------------------------------------
    def _encode(self, word: bytes) -> list[bytes]:
        """The merges of a short byte string, lowest rank first: decides which tokens may touch."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            r, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stands(self, token: bytes) -> bool:
        """A token that its own bytes really merge into."""
        if (got := self._token_memo.get(token)) is None:
            got = self._token_memo[token] = self._encode(token) == [token]
        return got

    def _touch(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are side by side."""
        if (got := self._pair_memo.get((left, right))) is None:
            got = self._pair_memo[left, right] = self._encode(left + right) == [left, right]
        return got

    def _compile(self, state: int, byte: int) -> None:
        """One transition of the counter.

        A word's last token is the one whose left neighbour, the last token of the word before
        it, can stand next to it; a word's count is one more than that of the word before it.
        """
        suffix, last, behind = self.key[state]  # of each prefix inside the suffix: last token, count less that of the whole
        word = suffix + bytes([byte])
        found = None
        for size in range(1, min(len(word), self.longest) + 1):
            token = word[-size:]
            if token not in self.tokens or not self._stands(token):
                continue
            at = len(word) - size  # index of the prefix before the token
            left = last[at] if at < len(last) else b""
            if left == b"" or self._touch(left, token):
                found = (token, (behind[at] if at < len(behind) else 0) + 1)
                break
        assert found is not None
        token, add = found
        last, behind = (*last, token) if last else (b"", token), (*behind, add) if behind else (0, add)
        cut = 0
        while word[cut:] not in self.prefixes:
            cut += 1
        # Only prefixes from the cut on can precede a token to come.
        key = (word[cut:], last[cut:], tuple(b - add for b in behind[cut:]))
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.key)
            self.key.append(key)
            if to >= len(self.to):
                self.to = np.vstack([self.to, np.full_like(self.to, -1)])
                self.adds = np.vstack([self.adds, np.zeros_like(self.adds)])
                self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.met[to] = self.passes
        c = self.column[byte]
        self.to[state, c], self.adds[state, c] = to, add

    def _columns_for(self, data: np.ndarray) -> None:
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                if self.used == self.columns:
                    self.to = np.hstack([self.to, np.full_like(self.to, -1)])
                    self.adds = np.hstack([self.adds, np.zeros_like(self.adds)])
                    self.columns *= 2
                self.column[b] = self.used
                self.used += 1

    # -- a batch ------------------------------------------------------------
    def starts(self, points: np.ndarray) -> np.ndarray:
        """Whether a pretoken starts at each code point (0x110000 ends a text)."""
        n = len(points)
        chunks = -(-n // CHUNK)
        kinds = np.full(chunks * CHUNK, _END, np.uint8)
        kinds[:n] = self.classes[points]
        lanes = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
        flat = self.next.ravel()
        maps = np.broadcast_to(np.arange(STATES, dtype=np.int16), (chunks, STATES)).copy()
        for row in lanes:
            maps = flat[maps * 12 + row[:, None]].astype(np.int16)
        step = 1
        while step < chunks:  # prefix scan: the map of all chunks up to each one
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
            step *= 2
        state = np.zeros(chunks, np.int16)
        state[1:] = maps[:-1, _S]
        here, before = np.zeros((CHUNK, chunks), bool), np.zeros((CHUNK, chunks), bool)
        here_of, before_of = self.here.ravel(), self.before.ravel()
        for i, row in enumerate(lanes):
            at = state * 12 + row
            here[i], before[i] = here_of[at], before_of[at]
            state = flat[at].astype(np.int16)
        out = here.T.ravel()[:n].copy()
        out[:-1] |= before.T.ravel()[1:n]
        return out

    def _count_pass(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; none of them holds a special token's string."""
        points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = 0x110000
        starts = self.starts(points)
        real = points != 0x110000
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        width = np.where(real, width, 0)
        offset = np.cumsum(width) - width
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        self._columns_for(data)
        begins = np.zeros(len(data), bool)
        begins[offset[real & starts]] = True
        cumulative = np.concatenate([[0], np.cumsum(self._deltas(data, begins), dtype=np.int64)])
        byte_ends = offset[ends]
        return np.diff(np.concatenate([[0], cumulative[byte_ends]]))

    def _deltas(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens that each byte adds, read in lanes that begin where pretokens do."""
        n = len(data)
        firsts = np.flatnonzero(begins)
        lanes = np.unique(firsts[np.searchsorted(firsts, np.arange(0, n, CHUNK), "right") - 1])
        sizes = np.diff(np.append(lanes, n))
        order = np.argsort(-sizes, kind="stable")
        lanes, sizes = lanes[order], sizes[order]
        columns = self.column[data].astype(np.int64)
        out = np.zeros(n, np.int8)
        state = np.zeros(len(lanes), np.int64)
        live = len(lanes)
        for i in range(int(sizes[0])):
            while sizes[live - 1] <= i:
                live -= 1
            if live == 1:  # the rest of a long pretoken
                self._read_on(int(state[0]), range(int(lanes[0]) + i, int(lanes[0] + sizes[0])), data, begins, columns, out)
                break
            at = lanes[:live] + i
            state = np.where(begins[at], 0, state[:live])
            self.met[state] = self.passes
            c = columns[at]
            to = self.to[state, c]
            if (missing := np.flatnonzero(to < 0)).size:
                for s, b in set(zip(state[missing].tolist(), data[at[missing]].tolist(), strict=True)):
                    self._compile(s, b)
                to = self.to[state, c]
            out[at] = self.adds[state, c]
            state = to.astype(np.int64)
        return out

    def _read_on(self, state: int, places: range, data: np.ndarray, begins: np.ndarray, columns: np.ndarray, out: np.ndarray) -> None:
        """The same for a single lane, byte by byte."""
        for at in places:
            if begins[at]:
                state = 0
            c = columns[at]
            if self.to[state, c] < 0:
                self._compile(state, int(data[at]))
            out[at] = self.adds[state, c]
            state = int(self.to[state, c])

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text, the strings of special tokens counting one each."""
        whole, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    split = [p.split(s) for p in parts]
                    total[i] += sum(len(p) - 1 for p in split)
                    parts = [q for p in split for q in p]
            for p in parts:
                if p:
                    whole.append(p)
                    owner.append(i)
        first = 0
        while first < len(whole):
            last, chars = first, 0
            while last < len(whole) and (last == first or chars + len(whole[last]) <= PASS_CHARS):
                chars += len(whole[last])
                last += 1
            self.passes += 1
            if len(self.key) > MAX_STATES:
                self._cut_back()
            if len(self._pair_memo) > MAX_PAIRS:
                self._pair_memo.clear()
            np.add.at(total, owner[first:last], self._count_pass(whole[first:last]))
            first = last
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The compiled tokenizer of a file, one for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    ``tokenizer`` is the name of a byte-level BPE file in public_tokenizers. A null text counts
    as empty: 0 bytes and 0 tokens. Whole texts are read, however long; rows are independent, so
    repeated rows and empty tables need nothing special. Columns of the input that are named
    like the added ones are replaced.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        c = counter(public_tokenizers.path(tokenizer))
        for texts in batches:
            yield pd.Series(c.count(texts.tolist()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"__bytes": F.octet_length(text).cast("long"), "__tokens": tokens(text)})
    out = out.withColumns({"n_bytes": F.col("__bytes"), "n_tokens": F.col("__tokens"), "over_limit": F.col("__tokens") > limit})
    return out.drop("__bytes", "__tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, "byte_bpe_50k.json").select("doc_id", "n_bytes", "n_tokens", "over_limit")
