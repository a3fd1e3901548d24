"""Token counts of byte-level BPE by two compiled deterministic transducers.

1. The splitter: an eight-state transducer over character classes that emits 1
   where a new word begins. Text is dealt into chunks; each chunk's map from entry
   state to exit state is computed for all chunks at once, the maps are composed by
   a prefix scan, and a last pass with known entry states emits the word starts.
2. The counter: a transducer over the bytes of a word. A prefix of a word matters for what
   follows only by its open suffixes, those that a longer token can begin with, and for
   each of them the token that stands before it and the tokens emitted since. That list is
   the state, so prefixes that agree in it are one state, and there are finitely many. A
   transition carries the change in emitted tokens. States are compiled when first met.
   Long words are cut into chunks; a chunk's map from entry state to (exit state, tokens)
   is known for the entries met so far, and maps of neighbours are composed in a tree.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import text_slices

CHUNK_CHARS = 64
# Bytes of a word's chunk.
CHUNK_BYTES = 128
# States, transitions and counted words kept by a worker; beyond this it starts anew.
MAX_STATES = 200_000
MAX_WORDS = 300_000
MAX_WORD_CHARS = 64
NEVER = 1 << 60
# A token before an open suffix counts by the tokens it lets follow where these are so few.
FEW_TOKENS = 8
# Bits of a count, and of a token, in a packed entry of a state; a count is stored with ZERO added.
COUNT_BITS, TOKEN_BITS = 12, 17
COUNT_MASK, TOKEN_MASK = (1 << COUNT_BITS) - 1, (1 << TOKEN_BITS) - 1
ZERO = 1 << COUNT_BITS - 1

# Unicode white space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings that the splitter cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

END, LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_LAST, WHITE_LAST, WHITE_RUN = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, TWO_LEFT, ONE_LEFT = range(8)


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point; white space as WHITE_RUN."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = WHITE_RUN
    return out


@functools.cache
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, flat tables indexed by symbol * 8 + state."""
    following, emitted = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE_1: IN_OTHER, QUOTE_2: IN_OTHER}
    for symbol in range(9):
        for state in range(8):
            if symbol == END:
                to, out = START, 0
            elif state in (TWO_LEFT, ONE_LEFT):
                to, out = (ONE_LEFT if state == TWO_LEFT else START), 0
            elif symbol == SPACE_LAST:
                to, out = AFTER_SPACE, 1
            elif symbol == WHITE_LAST:
                to, out = START, 1
            elif symbol == WHITE_RUN:
                to, out = IN_WHITE, int(state != IN_WHITE)
            elif state in (runs[symbol], AFTER_SPACE):
                to, out = runs[symbol], 0
            else:
                to, out = {QUOTE_1: ONE_LEFT, QUOTE_2: TWO_LEFT}.get(symbol, runs[symbol]), 1
            following[symbol, state], emitted[symbol, state] = to, out
    return following.ravel(), emitted.ravel()


def _symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Splitter symbols; ``ends`` are the places of separators between texts."""
    out = _classes()[codes]
    out[ends] = END
    after = np.append(out[1:], np.uint8(END))
    last = (out == WHITE_RUN) & (after != WHITE_RUN) & (after != END)
    out[last] = np.where(codes[last] == 32, SPACE_LAST, WHITE_LAST)
    quotes = np.flatnonzero((codes == 39) & (after == LETTER))
    if len(quotes):
        padded = np.concatenate((codes, [0, 0]))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        long = np.zeros(len(quotes), bool)
        for c in (c for c in CONTRACTIONS if len(c) == 2):
            long |= (one == ord(c[0])) & (two == ord(c[1]))
        out[quotes[short]] = QUOTE_1
        out[quotes[long]] = QUOTE_2
    return out


def _word_starts(symbols: np.ndarray, chunk: int = CHUNK_CHARS) -> np.ndarray:
    """1 where a word begins."""
    following, emitted = _splitter()
    n = -(-len(symbols) // chunk)
    cells = np.zeros(n * chunk, np.uint8)
    cells[:len(symbols)] = symbols * 8
    cells = np.ascontiguousarray(cells.reshape(n, chunk).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for column in cells:
        maps = following.take(column[:, None] + maps)
    step = 1
    while step < n:  # maps[i] becomes the map of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate((np.array([START], np.uint8), maps[:-1, START]))
    out = np.empty_like(cells)
    for i, column in enumerate(cells):
        at = column + state
        out[i] = emitted.take(at)
        state = following.take(at)
    return out.T.ravel()[:len(symbols)]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# The state before a word: the empty suffix, no token before it.
BEGIN = (ZERO,)


class TokenCounter:
    """The compiled transducers of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        # an added token is not spelled in byte letters and stands outside the vocabulary
        self.ids = {spell(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.spelled = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(self.ids[spell(a)], self.ids[spell(b)]): (rank, self.ids[spell(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self._spell_out()
        self.beside: dict[int, bool] = {}
        self.halves = {to: (rank, *pair) for pair, (rank, to) in self.merges.items()}
        self.spines: dict[int, list[tuple[int, int]]] = {}
        self.whole: dict[int, bool] = {}
        self._restart()

    def _spell_out(self) -> None:
        """The vocabulary as a trie; node 0 is the empty string."""
        if max(map(len, self.ids)) > ZERO // 2 or max(self.ids.values()) + 1 > TOKEN_MASK:
            raise ValueError("a token is too long, or the vocabulary too large, for a packed state")
        self.child: dict[int, int] = {}
        paths, self.token, self.below = {}, [-1], [0]
        for token, number in self.ids.items():
            node, path = 0, []
            for byte in token:
                path.append(node)
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.below.append(0)
            self.token[node] = number
            for above in path:
                self.below[above] += 1
            paths[number] = path
        # tokens that begin with a node's string and are longer, where there are few
        self.longer: dict[int, list[int]] = {}
        for number, path in paths.items():
            for node in path:
                if self.below[node] <= FEW_TOKENS:
                    self.longer.setdefault(node, []).append(number)

    def _restart(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.step: dict[int, int] = {}
        self.alike: dict[int, int] = {}
        self.standing: dict[tuple[int, int], int] = {}
        self.words: dict[str, int] = {}

    def encode(self, word: bytes) -> list[int]:
        """Plain BPE, used while compiling."""
        parts = [self.ids[word[i:i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.merges.get(p, (NEVER, 0))[0], i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == NEVER:
                break
            pair, to, out, i = (parts[best[1]], parts[best[1] + 1]), self.merges[parts[best[1]], parts[best[1] + 1]][1], [], 0
            while i < len(parts):
                if tuple(parts[i:i + 2]) == pair:
                    out.append(to)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` as BPE builds it, last first, each with the
        rank of the merge that took it in."""
        key = token << 1 | side
        if key not in self.spines:
            out, taken = [(token, NEVER)], NEVER
            while token in self.halves:
                taken, *parts = self.halves[token]
                token = parts[side]
                out.append((token, taken))
            self.spines[key] = out
        return self.spines[key]

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the joined bytes of a and b as these two tokens (a < 0: b alone).

        At any time one token of a's right edge stands before one of b's left edge; the
        two would merge if their rank came before the merges that take them in. At equal
        rank the merge further left goes first."""
        if a < 0:
            if b not in self.whole:
                self.whole[b] = self.encode(self.spelled[b]) == [b]
            return self.whole[b]
        key = a << 17 | b
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > MAX_STATES:
                self.beside = {}
            known = self.beside[key] = self._stand(a, b)
        return known

    def _stand(self, a: int, b: int) -> bool:
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            rank = self.merges.get((x, y), (NEVER, 0))[0]
            if rank < NEVER and rank < x_taken and rank <= y_taken:
                return False
            x_made = left[i + 1][1] if i + 1 < len(left) else -1
            y_made = right[j + 1][1] if j + 1 < len(right) else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                i += 1
            else:
                j += 1

    def _before(self, node: int, token: int) -> int:
        """A token that lets the same tokens follow at ``node`` as ``token`` does; -2: none follows."""
        if self.below[node] > FEW_TOKENS:
            return token
        key = node << TOKEN_BITS | (token + 1)
        known = self.alike.get(key)
        if known is None:
            mask = sum(1 << i for i, b in enumerate(self.longer[node]) if self._follows(token, b))
            known = self.alike[key] = self.standing.setdefault((node, mask), token) if mask else -2
        return known

    def _number(self, state: tuple[int, ...]) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _transition(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The state after one more byte and the change in emitted tokens.

        An entry is (node of the open suffix, token before it, tokens emitted since), longest
        suffix first; the last one is the empty suffix."""
        last, change, still = -1, 0, []
        for entry in state:
            node = self.child.get((entry >> COUNT_BITS + TOKEN_BITS) << 8 | byte)
            if node is None:
                continue
            before, since = (entry >> COUNT_BITS & TOKEN_MASK) - 1, (entry & COUNT_MASK) - ZERO
            if last < 0 and self.token[node] >= 0 and self._follows(before, self.token[node]):
                last, change = self.token[node], 1 - since
            if self.below[node]:
                still.append((node, before, since))
        if last < 0:
            raise ValueError("a byte is missing from the vocabulary")
        out = []
        for node, before, since in still:
            alike = self._before(node, before)
            if alike > -2:
                out.append((node << TOKEN_BITS | (alike + 1)) << COUNT_BITS | (since + change + ZERO))
        out.append((last + 1) << COUNT_BITS | ZERO)
        return tuple(out), change

    def _run(self, entry: tuple[int, ...], chunk: bytes) -> tuple[tuple[int, ...], int]:
        """(exit state, change in emitted tokens) of a chunk for one entry state."""
        if len(self.states) > MAX_STATES or len(self.step) > 2 * MAX_STATES or len(self.alike) > 2 * MAX_STATES:
            words = self.words
            self._restart()
            self.words = words
        at, total, step = self._number(entry), 0, self.step
        for byte in chunk:
            key = at << 8 | byte
            found = step.get(key)
            if found is None:
                state, change = self._transition(self.states[at], byte)
                found = step[key] = self._number(state) << COUNT_BITS | (change + ZERO)
            at = found >> COUNT_BITS
            total += (found & COUNT_MASK) - ZERO
        return self.states[at], total

    def _through(self, chunks: list[bytes], maps: list[dict], first: int, last: int, entry: tuple[int, ...]):
        """(exit state, change) of the chunks first to last - 1 for an entry; what is missing
        in their maps is added."""
        total = 0
        for i in range(first, last):
            found = maps[i].get(entry)
            if found is None:
                found = maps[i][entry] = self._run(entry, chunks[i])
            entry, total = found[0], total + found[1]
        return entry, total

    def count_word(self, word: bytes, size: int = CHUNK_BYTES) -> int:
        if len(word) <= size:
            return self._run(BEGIN, word)[1]
        chunks = [word[i:i + size] for i in range(0, len(word), size)]
        # Every chunk's map from the begin of a word, and from the state in which the chunk
        # before it, begun so, ends: states soon agree whatever came before.
        maps: list[dict] = [{BEGIN: self._run(BEGIN, c)} for c in chunks]
        for i in range(1, len(chunks)):
            entry = maps[i - 1][BEGIN][0]
            if entry not in maps[i]:
                maps[i][entry] = self._run(entry, chunks[i])
        spans = [(i, i + 1, dict(m)) for i, m in enumerate(maps)]
        while len(spans) > 1:  # neighbours' maps become one
            joined = []
            for (a, b, left), (_, c, right) in zip(spans[::2], spans[1::2]):
                out = {}
                for entry, (exit_state, n) in left.items():
                    if exit_state not in right:
                        right[exit_state] = self._through(chunks, maps, b, c, exit_state)
                    end, more = right[exit_state]
                    out[entry] = (end, n + more)
                joined.append((a, c, out))
            spans = joined + spans[len(joined) * 2:]
        return spans[0][2][BEGIN][1]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the tokenizer's special strings count as one each."""
        cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        parts, n_parts = [], []
        for text in texts:
            own = cut.split(text) if cut and any(s in text for s in self.special) else [text]
            parts += own
            n_parts.append(len(own))
        stream = "\0".join(parts) + "\0"
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = _word_starts(_symbols(codes, ends))
        marks[ends] = 2
        points = np.flatnonzero(marks)
        begins = marks[points] == 1
        starts, stops = points[begins], points[1:][begins[:-1]]
        if len(self.words) > MAX_WORDS:
            self.words = {}
        words, counts = self.words, np.empty(len(starts), np.int64)
        for i, (s, e) in enumerate(zip(starts.tolist(), stops.tolist())):
            word = stream[s:e]
            n = words.get(word)
            if n is None:
                n = self.count_word(word.encode("utf-8", "surrogatepass"))
                if e - s <= MAX_WORD_CHARS:
                    words[word] = n
            counts[i] = n
        total = np.concatenate(([0], np.cumsum(counts)))
        last = np.cumsum(n_parts)
        upto = total[np.searchsorted(starts, ends[last - 1])]
        return np.diff(upto, prepend=0) + np.array(n_parts) - 1


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``path`` names a byte-level BPE file that every executor has. A null text counts
    as empty (0 bytes, 0 tokens). Texts are never cut short; repeated rows each give
    a row and ids may be null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for first, texts in text_slices(batch.column(1)):
                n[first:first + len(texts)] = counter(path).count(texts)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
