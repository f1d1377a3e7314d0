"""Token counts by a tokenizer compiled to a finite-state transducer.

The byte-pair encoding of a piece of text is compiled, as far as texts ask for it, to a deterministic
transducer over bytes whose transitions carry the change of the number of tokens.  A text runs through it in
chunks of equal length, all at the same time: past the first end of a piece a chunk's state map is constant, so it is
run from there at once, and a prefix scan over the chunks gives each its entry state, from which only
its head is left to run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.words import raw, spans

CHUNK = 256  # bytes of a chunk
STATES = 60_000  # compiled states a worker keeps; beyond them it starts anew
_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4
_END = 256  # added to the last byte of a piece
_SKIP = 512  # leaves any state as it is
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: what an apostrophe can be one piece with
_compiled: dict[str, "Transducer"] = {}


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Transducer:
    """States are what the rest of a piece can depend on.

    For every start from which a token may still reach beyond the bytes read, a state holds
    the last token of the encoding before that start and how many tokens that encoding is short of the whole.  A
    token sequence is the encoding exactly if each neighbouring pair is the encoding of its own bytes, so
    one token ends at each byte and the next state follows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            model = json.load(handle)["model"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"] or ""
        if not suffix:
            raise ValueError("a vocabulary without word ends")
        self.token: dict[str, int] = {}

        def symbols(text: str) -> str:
            """A token as one character for each byte, the last one of a word shifted."""
            final = text.endswith(suffix) and text != suffix
            codes = [letters[c] for c in (text[: -len(suffix)] if final else text)]
            if final:
                codes[-1] += _END
            return "".join(map(chr, codes))

        self.text = [symbols(t) for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        self.token = {t: i for i, t in enumerate(self.text)}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbols(a), symbols(b)
            self.merges[self.token[a], self.token[b]] = (rank, self.token[a + b])
        self.begun = {t[:i] for t in self.text for i in range(len(t))}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = np.zeros(0x110000, dtype=np.uint8)  # 0: not asked yet
        self.valid: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(_SKIP + 1, -1, dtype=np.int32)
        self.column[_SKIP] = 0
        self.columns = 1
        self.state_of = {((0, -1, 0),): 0}
        self.states: list[tuple[str, tuple]] = [("", ((0, -1, 0),))]
        self.following = np.full((1024, 64), -1, dtype=np.int32)
        self.change = np.zeros((1024, 64), dtype=np.int16)
        self.following[:, 0] = np.arange(1024)

    def _encodes(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens are encoded as these two."""
        key = (left, right)
        known = self.valid.get(key)
        if known is None:
            ids = [self.token[c] for c in ("" if left < 0 else self.text[left]) + self.text[right]]
            while len(ids) > 1:
                best = min(
                    ((self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None
                )
                if best is None:
                    break
                (_, merged), i = best
                ids[i : i + 2] = [merged]
            known = self.valid[key] = ids == ([right] if left < 0 else [left, right])
        return known

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count."""
        text, starts = self.states[state]
        char = chr(symbol)
        for length, last, short in starts:
            token = self.token.get(text[len(text) - length :] + char)
            if token is not None and self._encodes(last, token):
                change = 1 - short
                break
        else:
            raise ValueError("no token ends here")
        if symbol >= _END:
            return 0, change
        text += char
        alive = tuple(
            (n + 1, last, short + change) for n, last, short in starts if text[len(text) - n - 1 :] in self.begun
        ) + ((0, token, 0),)
        longest = alive[0][0]
        text = text[len(text) - longest :]
        key = (text, alive)
        found = self.state_of.get(key)
        if found is None:
            found = self.state_of[key] = len(self.states)
            self.states.append(key)
        return found, change

    def _compile(self, state: np.ndarray, symbol: np.ndarray) -> None:
        """Add the transitions that some lane asks for."""
        for code in np.unique(state.astype(np.int64) * 1024 + symbol).tolist():
            s, c = divmod(code, 1024)
            if self.column[c] < 0:
                self.column[c] = self.columns
                self.columns += 1
                if self.columns > self.following.shape[1]:
                    wider = np.full((len(self.following), 2 * self.following.shape[1]), -1, dtype=np.int32)
                    wider[:, : self.following.shape[1]] = self.following
                    self.following = wider
                    self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)
            if self.following[s, self.column[c]] >= 0:
                continue
            to, change = self._step(s, c)
            if len(self.states) > len(self.following):
                n = len(self.following)
                more = np.full_like(self.following, -1)
                more[:, 0] = np.arange(n, 2 * n)
                self.following = np.concatenate([self.following, more])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
            self.following[s, self.column[c]] = to
            self.change[s, self.column[c]] = change

    def _run(self, lanes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step all lanes (symbols, one column a step) together; exit states and changes per symbol."""
        changes = np.zeros(lanes.shape, dtype=np.int16)
        state = state.copy()
        for t in range(lanes.shape[0]):
            symbol = lanes[t]
            column = self.column[symbol]
            to = self.following[state, column] if column.min(initial=0) >= 0 else np.full(len(state), -1)
            if to.min(initial=0) < 0:
                missing = (to < 0) | (column < 0)
                self._compile(state[missing], symbol[missing])
                column = self.column[symbol]
                to = self.following[state, column]
            changes[t] = self.change[state, column]
            state = to
        return state, changes

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the number of tokens at each symbol of whole pieces."""
        n = len(symbols)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, _SKIP, dtype=np.int32)
        padded[:n] = symbols
        lanes = padded.reshape(rows, CHUNK)
        ends = (lanes >= _END) & (lanes < _SKIP)
        settled = ends.any(axis=1)
        head = np.where(settled, ends.argmax(axis=1) + 1, CHUNK)
        head[0] = 0
        settled[0] = True
        inside = np.arange(CHUNK)[None, :] >= head[:, None]
        body = np.where(inside, lanes, _SKIP)
        leave, out = self._run(np.ascontiguousarray(body.T), np.zeros(rows, dtype=np.int32))
        out = np.ascontiguousarray(out.T)
        # Scan: a settled chunk leaves in a known state whatever it is entered in; others take their turn.
        known = settled.copy()
        todo = np.flatnonzero(head > 0)
        while len(todo):
            now = todo[known[todo - 1]]
            width = int(head[now].max())
            part = np.where(~inside[now, :width], lanes[now, :width], _SKIP)
            after, more = self._run(np.ascontiguousarray(part.T), leave[now - 1])
            out[now, :width] += more.T
            fresh = now[~settled[now]]
            leave[fresh] = after[~settled[now]]
            known[fresh] = True
            todo = np.setdiff1d(todo, now, assume_unique=True)
        return out.reshape(-1)[:n]

    def _kind(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point as the library's own pre-tokenizer sees it."""
        kinds = self.kinds[points]
        if not kinds.all():
            for p in np.unique(points[kinds == 0]).tolist():
                beside, marks = (
                    len(self.library.pre_tokenizer.pre_tokenize_str(f"{c}{chr(p)}{c}")) for c in "a!"
                )
                self.kinds[p] = {(1, 3): _LETTER, (2, 2): _SPACE, (3, 1): _OTHER}.get((beside, marks), _NUMBER)
            kinds = self.kinds[points]
        return kinds

    def _normal(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text)
        return text.lower()  # composed already, and one lower-case letter for each

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        extra = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if "<" in text or any(s[0] != "<" for s in self.special):
                for special in self.special:
                    if any(special in p for p in pieces):
                        split = [p.split(special) for p in pieces]
                        extra[i] += sum(len(s) - 1 for s in split)
                        pieces = [p for s in split for p in s]
            parts += map(self._normal, pieces)
            owner += [i] * len(pieces)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return extra
        kinds = self._kind(points)
        first = np.zeros(len(points) + 1, dtype=bool)
        first[np.cumsum(lengths)] = True
        first[0] = True
        first = first[:-1]
        start = first | (kinds == _NUMBER)
        start[1:] |= kinds[1:] != kinds[:-1]
        self._contract(points, kinds, first, start)
        last = np.ones(len(points), dtype=bool)
        last[:-1] = start[1:]
        solid = kinds != _SPACE
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        data = np.frombuffer(whole.encode(), dtype=np.uint8).astype(np.int32)
        final = np.cumsum(width) - 1
        data[final[last & solid]] += _END
        row = np.repeat(np.repeat(np.asarray(owner), lengths), width)
        keep = np.repeat(solid, width)
        symbols, row = data[keep], row[keep]
        if len(self.states) > STATES:
            self.reset()
        changed = self.changes(symbols) if len(symbols) else np.zeros(0)
        return extra + np.bincount(row, changed, len(texts)).astype(np.int64)

    @staticmethod
    def _contract(points: np.ndarray, kinds: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
        """Join an apostrophe that begins a piece to the letters it is contracted with, and end the piece there."""
        marks = np.flatnonzero((points == 39) & start)
        at = lambda i: np.where(i < len(points), points[np.minimum(i, len(points) - 1)], 0)
        joined = lambda i: (i < len(points)) & ~first[np.minimum(i, len(points) - 1)]
        for tail in _CONTRACTED:
            hit = np.ones(len(marks), dtype=bool)
            for j, char in enumerate(tail, 1):
                hit &= (at(marks + j) == ord(char)) & joined(marks + j)
            found = marks[hit]
            for j in range(1, len(tail) + 1):
                start[found + j] = False
            after = found + len(tail) + 1
            start[after[after < len(points)]] = True
            marks = marks[~hit]


def transducer(path: str) -> Transducer:
    """One transducer for each file and worker process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of ``text`` to every row; 0 for null.  Nothing is shuffled.

    A column of ``docs`` with the name of the count is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    names = [f"_{i}" for i in range(len(kept))]
    renamed = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(kept, names)])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(tokenizer)
        for batch in batches:
            data, offsets = raw(batch.column(at))
            for a, b in spans(offsets, 1 << 20):
                texts = [data[s:e].tobytes().decode() for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(own.counts(texts), pa.int64())], names=[*names, "_n"]
                )

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    out = renamed.mapInArrow(run, f"{schema}, _n long")
    return out.select(*[out[n].alias(c) for c, n in zip(kept, names)], out["_n"].alias(name))
