"""Token counts of every prefix of a text, by dynamic programming over byte-pair merges.

Of any run of bytes, the encoding of a prefix ends with one certain token, and
what comes before that token is the encoding of the shorter prefix. So a table of
last tokens, filled from left to right, gives the exact count of each prefix: a
token fits if it ends there and the merges would not have joined anything across
the border to the last token of the prefix before it. Counts are stored as
differences, one for each character. How long a prefix fits into a budget, or
how many tokens a prefix has, is then read from the table; nothing is encoded again.

The words of many texts are cut into pieces at once, and the table is filled for all
distinct pieces together, one place after the other. Long pieces, and words in which
characters act on each other, are filled one by one.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import free_name, lots, text_bytes, with_text

#: Bytes of text that are counted together.
LOT_BYTES = 4 << 20
#: Words and prefixes of words (or pairs of tokens) that a process keeps, and the length at most of these and of pieces counted together; they change the work only.
HELD_WORDS, HELD_PREFIXES, HELD_LENGTH = 500_000, 1_000_000, 48

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NO_RANK = 1 << 60
#: Kinds of characters that are known by themselves: letters, other marks, single digits, white space, and those whose words are counted character by character.
_L, _O, _N, _BLANK, _ODD = range(1, 6)
_KINDS = {"L": _L, "O": _O, "N": _N, "": _BLANK}
#: The letters of contractions after the apostrophe: of one letter, of two, the first of two.
_ONE, _TWO, _FIRST_OF_TWO = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll"), (b"r", b"v", b"l")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """A vocabulary's tokens with what the merges do at their borders."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str) -> None:
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocabulary[a], vocabulary[b]] = (n, vocabulary[a + b])
        # The tokens' bytes, by whether they end a piece.
        bare = {i: w.removesuffix(end) for w, i in vocabulary.items()}
        known = {i: bytes(byte_of[c] for c in w) for i, w in bare.items() if all(c in byte_of for c in w)}
        self.closing = {w: i for i, w in known.items() if bare[i] + end in vocabulary and vocabulary[bare[i] + end] == i}
        self.open = {w: i for i, w in known.items() if vocabulary.get(bare[i]) == i}
        self.surface = {i: (w, self.closing.get(w) == i) for i, w in known.items()}
        # What ends a token, with the token that it is, open or closing, or -1: no longer suffix needs a look where one is not in it.
        self.tails: dict[bytes, tuple[int, int]] = {}
        for w in self.open.keys() | self.closing.keys():
            for k in range(len(w)):
                self.tails.setdefault(w[k:], (self.open.get(w[k:], -1), self.closing.get(w[k:], -1)))
        self.longest = max(map(len, self.tails), default=0)
        # The same as a tree read from the last byte on: (state, byte before) and the state that follows, and each state's two tokens.
        number = {b"": 0} | {w: n for n, w in enumerate(self.tails, 1)}
        self.steps = pd.Index(np.array([number[w[1:]] << 8 | w[0] for w in self.tails], np.int64))
        self.ends = np.array([(-1, -1), *self.tails.values()], np.int64).T.copy()
        self.parts: dict[int, tuple[int, int, int] | None] = {}
        self.whole: dict[int, bool] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.apart: dict[int, bool] = {}
        # What is in apart as far as it was gathered last, with one more for pairs that aren't there.
        self.pairs, self.pairs_fit = pd.Index(np.zeros(0, np.int64)), np.zeros(1, bool)
        self.forget()

    def forget(self) -> None:
        """Drop the states of prefixes that have come up: a tree whose nodes have a last token, a count as a start and one as a whole piece."""
        self.edges: dict[int, int] = {}
        if len(self.apart) > HELD_PREFIXES:
            self.apart.clear()
        self.last, self.count, self.whole_count = array("q", [-1]), array("q", [0]), array("q", [0])

    def _grow(self, token: int) -> bool:
        """Merge the token's letters until nothing merges; whether that gives the token, whose parts are noted then."""
        letters, closes = self.surface[token]
        single = [letters[k : k + 1] for k in range(len(letters))]
        row = [self.open[c] for c in single[:-1]] + [(self.closing if closes else self.open)[single[-1]]]
        made: dict[int, tuple[int, int, int]] = {}
        while len(row) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(row, row[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                return False
            n, k = best
            new = self.rank[row[k], row[k + 1]][1]
            made[new] = (row[k], row[k + 1], n)
            row[k : k + 2] = [new]
        self.parts |= made
        if len(letters) == 1:
            self.parts[token] = None
        return row[0] == token

    def is_whole(self, token: int) -> bool:
        """Whether the merges make this token of its letters."""
        if token not in self.whole:
            self.whole[token] = self._grow(token)
        return self.whole[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether token may follow the last token before it, or begin a piece if that is -1; noted in apart."""
        known = self.apart[before << 32 | token] = self.is_whole(token) and (before < 0 or self.stay_apart(before, token))
        return known

    def all_fit(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """fits() for many tokens."""
        keys = before << 32 | tokens
        at = self.pairs.get_indexer(keys)
        out = self.pairs_fit[at]
        if (new := np.flatnonzero(at < 0)).size:
            distinct, which = np.unique(keys[new], return_inverse=True)
            known = [self.apart.get(k) for k in distinct.tolist()]
            known = [self.fits(k >> 32, k & 0xFFFFFFFF) if fit is None else fit for k, fit in zip(distinct.tolist(), known, strict=True)]
            out[new] = np.array(known)[which]
        return out

    def whole_counts(self, pieces: pa.LargeStringArray) -> pa.LargeListArray:
        """Of each piece, the tokens that each of its prefixes has as a whole piece, byte by byte."""
        if len(self.apart) > HELD_PREFIXES:
            self.apart.clear()
        if len(self.apart) < len(self.pairs) or len(self.apart) > 1.1 * len(self.pairs):
            self.pairs, self.pairs_fit = pd.Index(np.fromiter(self.apart, np.int64)), np.fromiter([*self.apart.values(), False], bool)
        # In order, pieces that share a prefix are neighbours.
        order = pc.sort_indices(pieces).to_numpy()
        data, bounds = text_bytes(pieces.take(pa.array(order)))
        sizes = np.diff(bounds)
        # By the place of a prefix's last byte, from one on: the first place with the same prefix. There, its last token and its counts as a start and as a whole piece.
        node, last = np.zeros(len(data) + 1, np.int64), np.full(len(data) + 1, -1)
        held = np.zeros((2, len(data) + 1), np.int32)
        rows = np.flatnonzero(sizes <= HELD_LENGTH)
        for place in range(HELD_LENGTH):
            rows = rows[sizes[rows] > place]
            if not len(rows):
                break
            here = bounds[rows] + place + 1
            key = node[here - 1] << 8 | data[here - 1] if place else data[here - 1].astype(np.int64)
            new = np.append(True, key[1:] != key[:-1])
            fresh = here[new]
            node[here] = fresh[np.cumsum(new) - 1]
            self._end_with(fresh, place + 1, data, node, last, held)
        for n in np.flatnonzero(sizes > HELD_LENGTH).tolist():
            if len(self.last) > HELD_PREFIXES:
                self.forget()
            run, start, end = Run(self), int(bounds[n]), int(bounds[n + 1])
            run.push(data[start:end].tobytes())
            node[start + 1 : end + 1] = np.arange(start + 1, end + 1)
            held[1, start + 1 : end + 1] = [self.whole_count[k] for k in run.nodes[1:]]
        back = np.empty_like(order)
        back[order] = np.arange(len(order), dtype=order.dtype)
        return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(held[1][node[1:]])).take(pa.array(back))

    def _end_with(self, fresh: np.ndarray, size: int, data: np.ndarray, node: np.ndarray, last: np.ndarray, held: np.ndarray) -> None:
        """Fill in the prefixes of so many bytes that end at fresh, as Run does it for one."""
        found, state, todo = [], np.zeros(len(fresh), np.int64), np.arange(len(fresh))
        for k in range(1, min(size, self.longest) + 1):
            state = self.steps.get_indexer(state << 8 | data[fresh[todo] - k]) + 1
            todo, state = todo[state > 0], state[state > 0]
            if not len(todo):
                break
            found.append((todo, state))
        for k in range(len(found), 0, -1):
            todo, state = found[k - 1]
            ends = fresh[todo]
            start = node[ends - k] if k < size else np.zeros(len(ends), np.int64)
            for side in (0, 1):
                token = self.ends[side][state]
                ask = np.flatnonzero((token >= 0) & (held[side][ends] == 0))
                ask = ask[self.all_fit(last[start[ask]], token[ask])]
                held[side][ends[ask]] = held[0][start[ask]] + 1
                if not side:
                    last[ends[ask]] = token[ask]
        if (missing := np.flatnonzero((held[:, fresh] == 0).any(axis=0))).size:
            end = int(fresh[missing[0]])
            raise ValueError(f"no token of the vocabulary ends {data[end - size : end].tobytes()!r}")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at the token's left (0) or right (1) border, the smallest first, each with the rank of the merge that ends it."""
        known = self.right if side else self.left
        if token not in known:
            edge, ends, at = [], _NO_RANK, token
            while True:
                edge.append((at, ends))
                parts = self.parts.get(at)
                if parts is None:
                    break
                at, ends = parts[side], parts[2]
            known[token] = edge[::-1]
        return known[token]

    def stay_apart(self, before: int, after: int) -> bool:
        """Whether two tokens in a row are never merged across their border.

        At any time there is one part on each side of it. They would be merged if
        that came before either is used up by a merge of its own; of the same rank,
        the merge further left comes first.
        """
        one, two = self._edge(before, 1), self._edge(after, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = one[i], two[j]
            joined = self.rank.get((x, y))
            if joined and joined[0] < x_ends and joined[0] <= y_ends:
                return False
            if i == len(one) - 1 and j == len(two) - 1:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class Run:
    """Bytes of a piece that grow from the left, and the node of each prefix."""

    __slots__ = ("data", "merges", "nodes")

    def __init__(self, merges: Merges) -> None:
        self.merges, self.data, self.nodes = merges, bytearray(), [0]

    def _new(self, place: int) -> int:
        """A node for the bytes before place: of the tokens that end there the one, open or closing, that stays apart from the last token before it."""
        m, nodes = self.merges, self.nodes
        tails, apart, lasts = m.tails, m.apart, m.last
        data = bytes(self.data[max(0, place - m.longest) : place])
        found, k = [], len(data) - 1
        while k >= 0 and (tokens := tails.get(data[k:])):
            found.append(tokens)
            k -= 1
        last, count, whole, at = -1, 0, 0, place - len(found)
        for opens, closes in reversed(found):
            if (opens >= 0 and last < 0) or (closes >= 0 and not whole):
                node = nodes[at]
                before = lasts[node]
                if opens >= 0 and last < 0:
                    fits = apart.get(before << 32 | opens)
                    if fits or (fits is None and m.fits(before, opens)):
                        last, count = opens, m.count[node] + 1
                if closes >= 0 and not whole:
                    fits = apart.get(before << 32 | closes)
                    if fits or (fits is None and m.fits(before, closes)):
                        whole = m.count[node] + 1
                if whole and last >= 0:
                    lasts.append(last)
                    m.count.append(count)
                    m.whole_count.append(whole)
                    return len(lasts) - 1
            at += 1
        raise ValueError(f"no token of the vocabulary ends {data!r}")

    def push(self, more: bytes) -> None:
        edges, nodes, place = self.merges.edges, self.nodes, len(self.data)
        self.data += more
        node = nodes[-1]
        for b in more:
            place += 1
            key = node << 8 | b
            node = edges.get(key)
            if node is None:
                node = self._new(place)
                if place <= HELD_LENGTH:
                    edges[key] = node
            nodes.append(node)

    def copy(self) -> Run:
        out = Run(self.merges)
        out.data, out.nodes = bytearray(self.data), list(self.nodes)
        return out

    def pop(self, number: int) -> None:
        if number:
            del self.data[-number:], self.nodes[-number:]

    def closed(self) -> int:
        """Tokens of the bytes as a whole piece."""
        return self.merges.whole_count[self.nodes[-1]]


class _State:
    """What is known before the next character of a word: tokens of finished pieces, and the piece under way.

    An apostrophe at a piece's start may begin a contraction: with one letter it
    is a piece of its own; of two letters, the first alone is no contraction yet.
    """

    __slots__ = ("done", "kind", "run", "waiting")

    def __init__(self, done: int = 0) -> None:
        self.done, self.kind, self.run, self.waiting = done, "", None, b""


class PrefixCounts:
    """Counts of the prefixes of words, with a tokenizer's own rules for characters, pieces and special strings."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
        model = rules["model"]
        kinds = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        fits = (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"].get("Regex") == _PATTERN
            and not splits[1]["add_prefix_space"]
            and kinds == ["NFC", "Replace", "Lowercase"]
            and not rules.get("post_processor")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in rules["added_tokens"])
        )
        if not fits:
            raise ValueError("prefix counts need a byte-level BPE whose words are closed by a mark and parted at white space")
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.characters: dict[str, tuple[str, bytes]] = {}
        self.alone: dict[str, bool] = {}
        # By code point: the kind, none yet if 0, and the code point that it becomes.
        self.kinds, self.becomes = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint32)
        self.words: dict[str, bytes] = {}

    def _normal(self, cluster: str) -> list[tuple[str, bytes]]:
        """(kind, bytes) of each character that a cluster becomes; kinds are L, N, O for others, and empty for white space."""
        if len(cluster) == 1 and cluster in self.characters:
            return [self.characters[cluster]]
        out = []
        for c in self.tokenizer.normalizer.normalize_str(cluster):
            if c not in self.characters:
                pieces = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a"))
                if pieces == 1:
                    kind = "L"
                elif pieces == 2:
                    kind = ""
                else:
                    kind = "N" if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(c + c)) == 2 else "O"
                # Kept under the normalised character; it stands for itself, as normalising twice changes nothing.
                self.characters[c] = (kind, c.encode())
            out.append(self.characters[c])
        if len(cluster) == 1 and len(out) == 1:
            self.characters[cluster] = out[0]
        return out

    def _feed(self, s: _State, kind: str, letters: bytes) -> None:
        """Let the state take a character."""
        if kind == "L" and s.kind == "O" and s.run.data == b"'":
            if letters in _ONE:
                s.run.push(letters)
                s.kind = "C"
            else:
                self._open(s, kind, letters)
                s.waiting = letters if letters in _FIRST_OF_TWO else b""
            return
        if s.waiting:
            first, s.waiting = s.waiting, b""
            if kind == "L" and first + letters in _TWO:
                mark = Run(self.merges)
                mark.push(b"'")
                s.done -= mark.closed()
                mark.push(first + letters)
                s.run, s.kind = mark, "C"
                return
        if kind == s.kind and kind in ("L", "O"):
            s.run.push(letters)
        else:
            self._open(s, kind, letters)

    def _open(self, s: _State, kind: str, letters: bytes) -> None:
        if s.run is not None:
            s.done += s.run.closed()
        s.kind, s.run = kind, None
        if kind:
            s.run = Run(self.merges)
            s.run.push(letters)

    def _total(self, s: _State) -> int:
        return s.done + (s.run.closed() if s.run is not None else 0)

    def _peek(self, s: _State, tail: list[tuple[str, bytes]]) -> int:
        """The count after tail, with the state as it was."""
        grown = 0
        at = s
        for kind, letters in tail:
            if at is s:
                if s.run is not None and kind == s.kind and kind in ("L", "O") and not s.waiting:
                    s.run.push(letters)
                    grown += len(letters)
                    continue
                # Another piece begins: the rest goes to a state of its own.
                at = _State(s.done)
                at.kind, at.waiting, at.run = s.kind, s.waiting, s.run and (s.run if len(s.run.data) > 2 else s.run.copy())
            self._feed(at, kind, letters)
        n = self._total(at)
        if s.run is not None:
            s.run.pop(grown)
        return n

    def _stands_alone(self, c: str) -> bool:
        """Whether nothing before c is composed with it."""
        if c not in self.alone:
            jamo = 0x1100 <= ord(c) <= 0x11FF or 0x16D63 <= ord(c) <= 0x16D6A
            self.alone[c] = c.isascii() or not (unicodedata.combining(c) or unicodedata.category(c)[0] in "MC" or jamo)
        return self.alone[c]

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        """The kinds of code points. An odd one is composed with others, may begin a contraction or doesn't become one character."""
        kinds = self.kinds[points]
        if not kinds.all():
            for p in np.unique(points[kinds == 0]).tolist():
                found = self._normal(chr(p))
                self.kinds[p] = _ODD
                if len(found) == 1 and chr(p) != "'" and self._stands_alone(chr(p)):
                    self.kinds[p], self.becomes[p] = _KINDS[found[0][0]], ord(found[0][1].decode())
            kinds = self.kinds[points]
        return kinds

    def of_word(self, word: str) -> list[int]:
        """The counts of the word's prefixes, from one character on."""
        out: list[int] = []
        special = [m for m in self.special if m in word]
        s = _State()
        start = from_special = 0
        while start < len(word):
            end = start + 1
            # What follows a special string is normalised without it.
            while end < len(word) and not self._stands_alone(word[end]) and not any(word.endswith(m, from_special, end) for m in special):
                end += 1
            for k in range(start + 1, end):
                out.append(self._peek(s, self._normal(word[start:k])))
            for kind, letters in self._normal(word[start:end]):
                self._feed(s, kind, letters)
            out.append(self._total(s))
            start = end
            for mark in special:
                if word.endswith(mark, from_special, end):
                    before = end - len(mark)
                    s = _State((out[before - 1] if before else 0) + 1)
                    out[-1], from_special = s.done, end
        return out

    def _folded(self, words: pa.Array) -> pa.Array:
        """words with ASCII letters in lower case, as the tokenizer has them, but for those that would then hold a special string."""
        lower = pc.ascii_lower(words)
        for mark in self.special:
            lower = pc.if_else(pc.match_substring(lower, mark), words, lower)
        return lower

    def _held_word(self, word: str) -> bytes:
        """of_word() as numbers of 32 bits, kept if the word is short."""
        held = self.words.get(word)
        if held is None:
            if len(self.merges.last) > HELD_PREFIXES:
                self.merges.forget()
            held = array("i", self.of_word(word)).tobytes()
            if len(word) <= HELD_LENGTH:
                if len(self.words) >= HELD_WORDS:
                    self.words.clear()
                self.words[word] = held
        return held

    def differences(self, words: pa.Array) -> pa.LargeListArray:
        """What each character of each word adds to the count; no word is empty."""
        data, bounds = text_bytes(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        kinds = self._kinds_of(points)
        odd = np.logical_or.reduceat(kinds == _ODD, places[:-1])
        for mark in self.special:
            odd |= pc.match_substring(words, mark).to_numpy(zero_copy_only=False)
        first = np.zeros(len(points), bool)
        first[places[:-1]] = True
        begins = first | (kinds == _N) | np.append(True, kinds[1:] != kinds[:-1])
        out = np.zeros(len(points), np.int32)
        single = np.repeat(odd, np.diff(places))
        plain = ~single & (kinds != _BLANK)
        if plain.any():
            out[plain] = self._of_pieces(self.becomes[points[plain]], begins[plain])
        if odd.any():
            counted = np.frombuffer(b"".join(map(self._held_word, words.filter(pa.array(odd)).to_pylist())), np.int32)
            out[single] = np.where(first[single], counted, np.diff(counted, prepend=np.int32(0)))
        return pa.LargeListArray.from_arrays(pa.array(places, pa.int64()), pa.array(out))

    def _of_pieces(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What each character, normalised, adds to the count of its piece; where pieces begin is marked."""
        data = points.astype(np.uint32).tobytes().decode("utf-32-le").encode()
        ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
        first = np.flatnonzero(begins)
        offsets = np.append(np.append(0, ends)[first], len(data))
        pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        counted = self.merges.whole_counts(pieces.dictionary).take(pieces.indices).flatten().to_numpy()[ends - 1]
        out = np.diff(counted, prepend=np.int32(0))
        out[first] = counted[first]
        return out

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What each character of the texts in a row adds to its text's count, and where each text's characters begin, with the end."""
        data, bounds = text_bytes(texts)
        leads = (data & 0xC0) != 0x80
        first = data[leads]
        places = np.concatenate([[0], np.cumsum(leads)])[bounds]
        # Bytes between words as pc.ascii_split_whitespace() sees them.
        blank = (first == 32) | ((first >= 9) & (first <= 13))
        found = pc.ascii_split_whitespace(pc.fill_null(texts, "")).flatten()
        words = self._folded(found.filter(pc.not_equal(pc.binary_length(found), 0))).dictionary_encode()
        out = np.zeros(len(first), np.int32)
        if len(words):
            out[~blank] = self.differences(words.dictionary).take(words.indices).flatten().to_numpy()
        return out, places


def stored(differences: np.ndarray, places: np.ndarray) -> pa.Array:
    """Each text's differences as zigzag numbers of seven bits a byte, the lowest first."""
    zigzag = ((differences << 1) ^ (differences >> 31)).astype(np.uint32)
    if not len(zigzag) or zigzag.max() < 128:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(zigzag.astype(np.uint8))])
    sizes = 1 + sum((zigzag >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(5):
        has = sizes > k
        out[(ends - sizes + k)[has]] = (zigzag[has] >> (7 * k)) & 127 | np.where(sizes[has] > k + 1, 128, 0)
    offsets = np.concatenate([[0], ends])[places]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def counts(differences: bytes) -> np.ndarray:
    """The counts of all prefixes, the empty one first, of stored differences."""
    data = np.frombuffer(differences, np.uint8)
    if len(data) and data.max() >= 128:
        starts = np.concatenate([[True], data[:-1] < 128])
        group = np.cumsum(starts) - 1
        shift = (np.arange(len(data)) - np.flatnonzero(starts)[group]) * 7
        zigzag = np.zeros(int(group[-1]) + 1, np.int64)
        np.add.at(zigzag, group, (data & 127).astype(np.int64) << shift)
    else:
        zigzag = data.astype(np.int64)
    return np.concatenate([[0], np.cumsum((zigzag >> 1) ^ -(zigzag & 1))])


_counters: dict[str, PrefixCounts] = {}


def prefix_counts(documents: DataFrame, tokenizer_path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents' columns (or keep) plus n_tokens and prefix_counts.

    n_tokens is the count of the whole text, prefix_counts the stored differences
    for tokens_at(), fitting() and counts(): every prefix, by characters, has the
    count that the tokenizer gives for it alone. Special strings in a text count
    as one token, as the tokenizer does it by itself. A null or empty text has no
    tokens and an empty table; repeated rows stay. No rows give no rows. If a
    kept column has such a name, the new one gets a leading underscore.
    Tokenizers without closing marks are refused.
    """
    kept = documents.columns if keep is None else keep
    rows, text_at, n_kept = with_text(documents, text_col, kept)
    fields = list(rows.schema)[:n_kept]
    new = [free_name(c, documents.select(*[F.col(f"`{k}`") for k in kept])) for c in ("n_tokens", "prefix_counts")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{new[0]}` long", f"`{new[1]}` binary"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
        if path not in _counters:
            _counters[path] = PrefixCounts(path)
        for batch in batches:
            for a, b in lots(batch.column(text_at), LOT_BYTES):
                part = batch.slice(a, b - a)
                differences, places = _counters[path].of_texts(part.column(text_at))
                run = np.concatenate([[0], np.cumsum(differences, dtype=np.int64)])[places]
                columns = [pa.array(np.diff(run), pa.int64()), stored(differences, places).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *columns], [f.name for f in fields] + new)

    return rows.mapInArrow(counted, schema)


@pandas_udf(LongType())
def tokens_at(table: pd.Series, characters: pd.Series) -> pd.Series:
    """Tokens of the prefix of so many characters; of the whole text if it has fewer, null if either is null or it is negative."""

    def one(stored_counts: bytes | None, place: float) -> int | None:
        if stored_counts is None or pd.isna(place) or place < 0:
            return None
        found = counts(stored_counts)
        return int(found[min(int(place), len(found) - 1)])

    return pd.Series([one(t, p) for t, p in zip(table, characters, strict=True)], dtype="Int64")


@pandas_udf(LongType())
def fitting(table: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix with at most budget tokens; null if either is null or the budget is negative."""

    def one(stored_counts: bytes | None, most: float) -> int | None:
        if stored_counts is None or pd.isna(most) or most < 0:
            return None
        return int(np.flatnonzero(counts(stored_counts) <= most)[-1])

    return pd.Series([one(t, m) for t, m in zip(table, budget, strict=True)], dtype="Int64")


def truncated(text: Column, table: Column, budget: Column) -> Column:
    """The longest prefix of text with at most budget tokens."""
    return F.substring(text, F.lit(1), fitting(table, budget).cast("int"))
