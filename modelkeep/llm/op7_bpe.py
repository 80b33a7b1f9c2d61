"""Byte-level BPE as a tokenization automaton.

The automaton reads tokens.  It starts as one state that every byte token
leads back to; each merge (u, v), in order of rank, adds one gadget:

* the arcs labelled u lead to a new copy of their target, without its arc v
  (u may no longer be followed by v), and
* wherever u could be read and then v, an arc labelled uv leads to where v led.

(Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA".)
All arcs of one label lead to one state, so a state is known by the label that
leads to it, and a path is a BPE tokenization exactly if the automaton reads
it.  A table with every state and label would have 2.5e9 cells, so the driver
compiles the gadgets (for each token its two halves and its rank, for each
pair the rank of the gadget that took the arc away), and a cell of the
transition table is worked out from them when it is first read.

A pre-split word has one accepted path.  It is found by reading the longest
possible label first and, where the automaton has no such arc, the next
shorter one; as each position can be reached by one path only, a position that
led nowhere is never tried again.  Decoding writes the labels of the arcs.

Texts are cut into runs (white space and what follows it) for many texts at
once; equal runs are found by their hashes and verified by their bytes, and
only distinct ones go through the automaton.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from modelkeep.llm import words as W
from modelkeep.llm.common import fresh, grouped, hex_sha256, id_and_text, settle

#: Fixed value: the pre-split pattern of byte-level BPE, with Unicode classes.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of that pattern's classes.  A word of the pattern never begins
#: before such a character and ends after it unless it begins there, so texts
#: fall into runs that are split, and remembered, each on its own.
_SPACE = r" \t\n\r\x0b\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

#: What of it a run of the vector code begins with, and the characters of
#: several bytes in UTF-8; texts that hold one of these are one run each.
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WIDE_SPACE = re.compile(f"[{_SPACE}]".replace(r" \t\n\r\x0b\f", ""))

#: Classes of bytes in runs whose words are known from these: letters (with the
#: letters U+00C0 to U+023F in two bytes), digits, other signs, white space; and
#: bytes that only the pattern decides about.
_LETTER, _DIGIT, _SIGN, _BLANK, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[_ASCII_SPACE] = _BLANK
_KIND[ord("'")] = _HARD

#: Transitions a worker remembers: about 10 MB.
CELLS_KEPT = 1 << 20

#: Words of more bytes are read one by one.
LONG = 48

#: Bytes of text whose equal runs are read once, and words that go through the table in step.
SLICE, WORDS = 1 << 21, 1 << 14

_NEVER = 1 << 60

def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files:
    printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(shifted)}}


class Automaton:
    """The gadgets of a merge list, and the reading and writing of paths."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        char = byte_characters()
        label = {token: bytes(char[c] for c in token) for token in vocabulary if all(c in char for c in token)}
        self.id_of = {text: vocabulary[token] for token, text in label.items()}
        self.label = {i: text for text, i in self.id_of.items()}
        self.added = added or {}
        self.label.update({i: text.encode() for text, i in self.added.items()})
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        self.taken: dict[tuple[int, int], int] = {}  # (u, v) -> rank of the gadget that took the arc
        for rank, (u, v) in enumerate(merges):
            a, b = vocabulary[u], vocabulary[v]
            # A merge whose halves are never made, or never read one after the other, never happens.
            made = all(len(self.label[x]) == 1 or x in self.halves for x in (a, b))
            if not made or (a, b) in self.taken or not self._arc(a, b, rank):
                continue
            self.taken[a, b] = rank
            self.halves.setdefault(vocabulary[u + v], (rank, a, b))
        readable = {i for i in self.label if i in self.halves or len(self.label[i]) == 1}
        self.tokens = {text: i for text, i in self.id_of.items() if i in readable}
        self.longest = max(map(len, self.tokens), default=0)
        self.splitter = regex.compile(PRE_SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @classmethod
    def from_json(cls, text: str) -> Automaton:
        """From a tokenizer file with a byte-level BPE model and no normaliser."""
        file = json.loads(text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        return cls(file["model"]["vocab"], merges, {t["content"]: t["id"] for t in file.get("added_tokens", [])})

    def _arc(self, u: int, v: int, before: float) -> bool:
        """Whether, before the gadget ``before``, the state that u leads to has an arc v."""
        while True:
            if self.taken.get((u, v), _NEVER) < before:
                return False
            made_u = self.halves.get(u, (-1, 0, 0))
            made_v = self.halves.get(v, (-1, 0, 0))
            if made_u[0] < 0 and made_v[0] < 0:
                return True
            if made_v[0] > made_u[0]:
                # The gadget of v added the arc where its left half could be read just then.
                rank, left, right = made_v
                if u == left == right:
                    return False
                before, v = rank, left
            elif made_u[0] > made_v[0]:
                # The state was then the one that the right half of u led to.
                before, u = made_u[0], made_u[2]
            else:
                rank, left, right = made_u
                before, u, v = rank, right, left
                if left == right:
                    return True

    def reads(self, u: int, v: int) -> bool:
        """The cell (u, v) of the transition table."""
        return self._arc(u, v, _NEVER - 1)

    def path(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        n, at, last, path, dead, below = len(word), 0, -1, [], None, _NEVER
        tokens, longest = self.tokens, self.longest
        while at < n:
            for length in range(min(longest, n - at, below - 1), 0, -1):
                to = at + length
                token = tokens.get(word[at:to])
                if token is None or dead and to in dead or last >= 0 and not self.reads(last, token):
                    continue
                path.append(token)
                at, last, below = to, token, _NEVER
                break
            else:
                if not path:
                    raise ValueError(f"the vocabulary can't spell {word[:40]!r}")
                dead = dead or set()
                dead.add(at)
                below = len(self.label[path.pop()])
                at, last = at - below, path[-1] if path else -1
        return path

    def _split(self, run: str) -> list[int]:
        """The ids of white space and what follows it, as far as the next white space."""
        ids: list[int] = []
        for word in self.splitter.findall(run):
            ids += self.path(word.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without special tokens around it; added
        tokens that stand in the text are one id."""
        ids: list[int] = []
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.added:
                ids.append(self.added[part])
                continue
            for run in RUNS.findall(part):
                ids += self._split(run)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, special tokens included."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


class Table:
    """An automaton's gadgets and labels as arrays, to read many words at once.

    It is made on the driver and travels as a few MB; the trie's upper nodes get
    a row for every byte where it arrives, deeper ones are looked up.
    """

    def __init__(self, own: Automaton):
        size = max(own.label, default=0) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for token, (rank, u, v) in own.halves.items():
            self.rank[token], self.left[token], self.right[token] = rank, u, v
        pairs = sorted((u << 32 | v, rank) for (u, v), rank in own.taken.items())
        self.pairs = np.array([*(p for p, _ in pairs), _NEVER << 2], np.int64)
        self.ranks = np.array([*(r for _, r in pairs), _NEVER], np.int64)
        self.added = own.added
        texts = [own.label.get(k, b"") for k in range(size)]
        self.label_bytes, self.label_ends = b"".join(texts), np.cumsum([len(t) for t in texts]).astype(np.int32)
        # The labels as a trie: a sorted key (node, byte) for each child, nodes in the order of their depth.
        labels = sorted(own.tokens)
        data, length = np.frombuffer(b"".join(labels), np.uint8), np.array([len(x) for x in labels], np.int64)
        self.longest = int(length.max(initial=0))
        first, node, nodes, keys, self.shallow = np.cumsum(length) - length, np.zeros(len(labels), np.int64), 1, [], 1
        for at in range(self.longest):
            more = np.flatnonzero(length > at)
            key, of = np.unique(node[more] << 8 | data[first[more] + at], return_inverse=True)
            node[more] = nodes + of
            keys.append(key)
            nodes += len(key)
            if at == 1:
                self.shallow = nodes  # nodes of at most two bytes
        self.keys = np.append(np.concatenate(keys) if keys else np.zeros(0, np.int64), _NEVER).astype(np.int64)  # the child of key k is node k + 1
        self.token = np.full(nodes, -1, np.int32)
        self.token[node] = [own.tokens[x] for x in labels]
        self.__setstate__(self.__getstate__())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("child", "known", "cells", "splitter", "specials", "labels", "written")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.child = np.zeros((self.shallow, 256), np.int32)
        upper = np.flatnonzero(self.keys >> 8 < self.shallow)
        self.child[self.keys[upper] >> 8, self.keys[upper] & 255] = upper + 1
        self.known, self.cells = np.array([_NEVER << 2], np.int64), np.zeros(1, bool)
        self.splitter = regex.compile(PRE_SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.labels = np.frombuffer(self.label_bytes, np.uint8), self.label_ends.astype(np.int64)
        decimal = [f"{k},".encode() for k in range(len(self.label_ends))]
        self.written = np.frombuffer(b"".join(decimal), np.uint8), np.cumsum([len(d) for d in decimal])

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; 0: none."""
        out = np.zeros(len(node), np.int64)
        upper = node < self.shallow
        out[upper] = self.child[node[upper], byte[upper]]
        deep = np.flatnonzero(~upper)
        key = node[deep] << 8 | byte[deep]
        at = np.searchsorted(self.keys, key)
        out[deep] = np.where(self.keys[at] == key, at + 1, 0)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, special tokens included."""
        data, ends = self.labels
        return b"".join([data[a:b].tobytes() for a, b in zip((ends - np.diff(ends, prepend=0))[ids].tolist(), ends[ids].tolist())]).decode("utf-8", "replace")

    def apart(self, text: bytes) -> bool:
        """Whether a text can't be cut at its ASCII white space: it holds an added token or other white space."""
        if not text.isascii() and _WIDE_SPACE.search(text.decode()):
            return True
        return any(t.encode() in text for t in self.added)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; added tokens that stand in it are one id."""
        out = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], np.int64))
                continue
            words = [w.encode() for w in self.splitter.findall(part)]
            short = [w if len(w) <= LONG else b"" for w in words]
            ids, depth = self.paths(np.frombuffer(b"".join(short), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in short])]).astype(np.int64))
            cuts = np.concatenate([[0], np.cumsum(depth)])
            done = 0
            for k, word in enumerate(words):
                if len(word) > LONG:
                    out += [ids[cuts[done]:cuts[k]], self._paths(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]]
                    done = k
            out.append(ids[cuts[done]:])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The cells (u, v) of the transition table, worked out from the gadgets as ``Automaton._arc`` does."""
        out = np.zeros(len(u), bool)
        todo, before = np.arange(len(u)), np.full(len(u), _NEVER - 1)
        while len(todo):
            key = u << 32 | v
            at = np.searchsorted(self.pairs, key)
            open_ = (self.pairs[at] != key) | (self.ranks[at] >= before)
            todo, u, v, before = (x[open_] for x in (todo, u, v, before))
            made_u, made_v = self.rank[u].astype(np.int64), self.rank[v].astype(np.int64)
            later, same = made_v > made_u, made_v == made_u
            twice = self.left[u] == self.right[u]
            yes = same & ((made_u < 0) | twice)
            no = later & (u == self.left[v]) & (u == self.right[v])
            out[todo[yes]] = True
            u, v, before = np.where(later, u, self.right[u]).astype(np.int64), np.where(later | same, self.left[v], v).astype(np.int64), np.where(later, made_v, made_u)
            go = ~yes & ~no
            todo, u, v, before = (x[go] for x in (todo, u, v, before))
        return out

    def reads(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The same, from the cells read before where these are known."""
        key = u << 32 | v
        at = np.searchsorted(self.known, key)
        new = np.unique(key[self.known[at] != key])
        if len(new):
            cells = self.arcs(new >> 32, new & 0xFFFFFFFF)
            if len(self.known) > CELLS_KEPT:
                self.known, self.cells = self.known[-1:], self.cells[-1:]
                return self.reads(u, v)
            place = np.searchsorted(self.known, new)
            self.known, self.cells = np.insert(self.known, place, new), np.insert(self.cells, place, cells)
            at = np.searchsorted(self.known, key)
        return self.cells[at]

    def paths(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words between ``bounds``, one after the other, and how many each has."""
        found = [self._paths(data[bounds[k]:bounds[min(k + WORDS, len(bounds) - 1)]], bounds[k:k + WORDS + 1] - bounds[k])
                 for k in range(0, len(bounds) - 1, WORDS)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _paths(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words read in step: each takes the longest label it hasn't tried at
        its place, goes on where the automaton has that arc, and back where no
        label is left.
        """
        n = len(bounds) - 1
        # Every label that begins at some byte, the longest first.
        place, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        after, own_place, own_token, own_length = np.repeat(bounds[1:], np.diff(bounds)), [], [], []
        for at in range(self.longest):
            node = self._step(node, data[place + at].astype(np.int64))
            alive = node > 0
            place, node = place[alive], node[alive]
            if not len(place):
                break
            token = self.token[node].astype(np.int64)
            ends = token >= 0
            own_place.append(place[ends])
            own_token.append(token[ends])
            own_length.append(np.full(int(ends.sum()), at + 1))
            alive = place + at + 1 < after[place]
            place, node = place[alive], node[alive]
        place, token, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (own_place, own_token, own_length))
        order = np.argsort(place * 256 + (255 - length)) if self.longest < 256 else np.lexsort((-length, place))
        place, token, length = place[order], token[order], length[order]
        first = np.searchsorted(place, np.arange(len(data) + 1))
        at, depth = bounds[:-1].copy(), np.zeros(n, np.int64)
        tried = first[at] if n else at
        dead = np.zeros(len(data) + 1, bool)
        taken = np.zeros((int(np.diff(bounds).max(initial=0)) + 1, n), np.int32)  # the label's place in the list, by depth
        todo = np.flatnonzero(np.diff(bounds) > 0)
        while len(todo):
            stuck = tried[todo] >= first[at[todo] + 1]
            back = todo[stuck]
            if len(back):
                if (depth[back] == 0).any():
                    raise ValueError("the vocabulary can't spell a word")
                dead[at[back]] = True
                depth[back] -= 1
                label = taken[depth[back], back]
                at[back] -= length[label]
                tried[back] = label + 1
            go = todo[~stuck]
            label = tried[go]
            to = at[go] + length[label]
            fits = ~dead[to] | (to == bounds[go + 1])
            check = np.flatnonzero(fits & (depth[go] > 0))
            fits[check] = self.reads(token[taken[depth[go[check]] - 1, go[check]]], token[label[check]])
            tried[go[~fits]] += 1
            on, label, to = go[fits], label[fits], to[fits]
            taken[depth[on], on] = label
            depth[on] += 1
            at[on] = to
            unfinished = to < bounds[on + 1]
            tried[on[unfinished]] = first[to[unfinished]]
            todo = todo[at[todo] < bounds[todo + 1]]
        return token[taken.T[np.arange(len(taken)) < depth[:, None]]], depth


class Runs:
    """The runs of a slice of texts: ``of`` names the distinct run of each, and
    the runs of text k are those from ``first[k]`` to ``first[k + 1]``.
    ``ids[cuts[d]:cuts[d + 1]]`` are the ids of the distinct run d."""

    def __init__(self, table: Table, data: np.ndarray, bounds: np.ndarray):
        raw = data.tobytes()
        begin, end, first = _runs(data, bounds)
        whole = [k for k in range(len(bounds) - 1) if table.apart(raw[bounds[k]:bounds[k + 1]])]
        if whole:
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
            keep = ~np.isin(text, whole)
            begin, end = (np.concatenate([x[keep], y]) for x, y in ((begin, bounds[whole]), (end, bounds[np.array(whole) + 1])))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], end[order]
            first = np.searchsorted(begin, bounds)
        h = W.hashes(data, begin, end)
        _, at, of = np.unique(h, return_index=True, return_inverse=True)
        length = end - begin
        same = length == length[at][of]
        same[same] = W.same_bytes(data, begin[same], data, begin[at][of][same], length[same])
        if not same.all():  # other runs with one hash: each stands for itself
            odd = np.flatnonzero(~same)
            of[odd] = len(at) + np.arange(len(odd))
            at = np.concatenate([at, odd])
        self._read(table, data, raw, begin[at], end[at], np.isin(begin[at], bounds[whole]) if whole else np.zeros(len(at), bool))
        self.of, self.first = self.place[of], first

    def _read(self, table: Table, data: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray, special: np.ndarray) -> None:
        """The ids of the distinct runs.  Most are cut into words by the classes of
        their bytes, all at once; the pattern cuts the others one by one."""
        length = end - begin
        bounds = np.concatenate([[0], np.cumsum(length)])
        flat = data[np.repeat(begin - bounds[:-1], length) + np.arange(int(bounds[-1]))]
        kind = _KIND[flat]
        signs = np.flatnonzero(flat == 0xC3)  # U+00D7 and U+00F7 are no letters
        kind[signs[np.isin(flat[signs + 1], (0x97, 0xB7))]] = _HARD
        head = bounds[:-1]
        hard = special | (length > LONG)
        if len(flat):
            hard |= np.logical_or.reduceat(kind == _HARD, head)
            second = np.minimum(head + 1, len(flat) - 1)
            hard |= (length > 1) & (kind[head] == _BLANK) & (kind[second] == _BLANK)
            new = np.ones(len(flat), bool)
            new[1:] = kind[1:] != kind[:-1]
            new[second[(length > 1) & (flat[head] == 0x20)]] = False
            new[head] = True
        else:
            new = np.zeros(0, bool)
        easy, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        self.place = np.empty(len(length), np.int64)
        self.place[np.concatenate([easy, rest])] = np.arange(len(length))
        keep = np.repeat(~hard, length)
        words_of = np.add.reduceat(new, head)[easy] if len(flat) else np.zeros(0, np.int64)
        starts = np.flatnonzero(new[keep])
        parts, sizes = [], []
        for k in rest.tolist():
            run = raw[begin[k]:end[k]].decode()
            if special[k] or length[k] > LONG:
                sizes.append(table.encode(run))
            else:
                own = [w.encode() for w in table.splitter.findall(run)]
                sizes.append(len(own))
                parts += own
        lengths = np.concatenate([np.diff(np.append(starts, int(keep.sum()))), [len(w) for w in parts]]).astype(np.int64)
        ids, depth = table.paths(np.concatenate([flat[keep], np.frombuffer(b"".join(parts), np.uint8)]), np.concatenate([[0], np.cumsum(lengths)]))
        counts = np.concatenate([words_of, [0 if isinstance(x, np.ndarray) else x for x in sizes]]).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(depth)])[np.concatenate([[0], np.cumsum(counts)])]
        whole = {len(easy) + j: x for j, x in enumerate(sizes) if isinstance(x, np.ndarray)}
        if whole:  # their ids go in where nothing stands yet
            at = [cuts[k] for k in whole]
            ids = np.insert(ids, np.repeat(at, [len(x) for x in whole.values()]), np.concatenate(list(whole.values())))
            more = np.zeros(len(counts) + 1, np.int64)
            more[np.array(list(whole)) + 1] = [len(x) for x in whole.values()]
            cuts = cuts + np.cumsum(more)
        self.ids, self.cuts, self.sizes = ids, cuts, np.diff(cuts)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and the places between the texts' ids."""
        size = self.sizes[self.of]
        after = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.cuts[self.of] - after[:-1], size) + np.arange(int(after[-1]))
        return self.ids[at], after[self.first]

    def joined(self, data: np.ndarray, ends: np.ndarray, between: int = 0) -> list[bytes]:
        """For each distinct run the parts of its ids, one after the other: part
        k ends at ``ends[k]`` of ``data``.  ``between`` bytes at the end of the last one are left out."""
        begins = ends - np.diff(ends, prepend=0)
        size = (ends - begins)[self.ids]
        after = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.repeat(begins[self.ids] - after[:-1], size) + np.arange(int(after[-1]))].tobytes()
        cuts = after[self.cuts].tolist()
        return [raw[a:max(a, b - between)] for a, b in zip(cuts[:-1], cuts[1:])]


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run, ASCII white space and then what follows it, or
    white space at a text's end; and the texts' first runs."""
    space = _ASCII_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[bounds] = True
    places = np.flatnonzero(cut)
    begin, end = places[:-1], places[1:]
    if not len(data):
        begin = end = np.zeros(0, np.int64)
    return begin, end, np.searchsorted(begin, bounds)


def _shared(spark, path: str):
    """The table of a tokenizer file (a few MB, bounded by its vocabulary), compiled here, as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Table(Automaton.from_json(file.read())))


def _text_column(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.string()).fill_null("")


def encode_column(spark, path: str):
    """A function of a text column: its ids as array<int> (null: empty)."""
    shared = _shared(spark, path)

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, bounds in W.slices(_text_column(texts)):
            ids, cuts = Runs(shared.value, data, bounds).flat()
            parts.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    return encode


def decode_column(spark, path: str):
    """A function of an ids column: the decoded text (null: empty)."""
    shared = _shared(spark, path)

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        table = shared.value
        return pa.array([table.decode(row.values.to_numpy()) if row.is_valid else "" for row in ids], pa.string())
    return decode


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256,
    decoded_sha256 (of the ids encoded and then decoded again).

    Null and empty texts have no ids; the id may be null or repeated; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    shared = _shared(spark, path)

    def run(batches):
        for batch in grouped(batches, 1, 2 * SLICE):
            n, ids_sha, text_sha = [], [], []
            for _, _, data, bounds in W.slices(batch.column(1), 2 * SLICE):
                runs = Runs(shared.value, data, bounds)
                n.append(np.diff(np.concatenate([[0], np.cumsum(runs.sizes[runs.of])])[runs.first]))
                of, written, labels = runs.of.tolist(), runs.joined(*shared.value.written, 1), runs.joined(*shared.value.labels)
                for a, b in zip(runs.first[:-1].tolist(), runs.first[1:].tolist()):
                    own = of[a:b]
                    ids_sha.append(hex_sha256(b",".join([written[k] for k in own])))
                    text_sha.append(hex_sha256(b"".join([labels[k] for k in own]).decode("utf-8", "replace").encode()))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: ids, n_tokens and decoded_sha256, the
    digest of the decoded ids.  Taken names get a ``_``.  Null texts are empty
    and have no ids; an empty table gives no rows."""
    settle(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)
    more = [(fresh(docs, "ids"), "array<int>"), (fresh(docs, "n_tokens"), "long"), (fresh(docs, "decoded_sha256"), "string")]
    at = next(k for k, c in enumerate(docs.columns) if c == text_col)

    def run(batches):
        for batch in grouped(batches, at, SLICE):
            ids, sha = [], []
            for _, _, data, bounds in W.slices(_text_column(batch.column(at)), SLICE):
                runs = Runs(shared.value, data, bounds)
                flat, cuts = runs.flat()
                ids.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())))
                of, labels = runs.of.tolist(), runs.joined(*shared.value.labels)
                sha += [hex_sha256(b"".join([labels[k] for k in of[a:b]]).decode("utf-8", "replace").encode())
                        for a, b in zip(runs.first[:-1].tolist(), runs.first[1:].tolist())]
            all_ids = pa.concat_arrays(ids)
            yield pa.record_batch([*batch.columns, all_ids, pa.array(np.diff(all_ids.offsets.to_numpy()), pa.int64()), pa.array(sha, pa.string())],
                                  names=[*batch.schema.names, *(name for name, _ in more)])
    schema = docs.schema
    for name, kind in more:
        schema = StructType(schema.fields + StructType.fromDDL(f"`{name}` {kind}").fields)
    return docs.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded; ``path`` is a tokenizer file."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or tokenizer_path("byte_bpe_50k.json"))
