"""Segmentation lattices of words over a fixed piece vocabulary, shared through a trie of their prefixes.

A word is spelled with the word mark in front. Every substring that is a piece is an
edge of its lattice; any character can also be spelled by byte pieces, so that each
word has a segmentation. Words with the same beginning share the trie nodes of that
beginning: what is computed there is computed once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: Probability kept for all 256 byte pieces together.
BYTE_MASS = 1e-4
BYTE_LOG = math.log(BYTE_MASS / 256)
#: Words of more characters take a scalar recursion instead of a column per character.
WIDE = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary file in the order of their scores, best first.

    Control and byte pieces and pieces that no text can use are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [
        (-model.get_score(i), i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        and model.get_score(i) > -1e8
    ]
    return [model.id_to_piece(i) for _, i in sorted(rows)]


def rank_log_probs(n: int) -> np.ndarray:
    """Log-probabilities from the rank that a vocabulary's scores give, by Zipf's law."""
    p = 1.0 / (np.arange(n) + 10.0)
    return np.log(p / p.sum() * (1 - BYTE_MASS))


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))


class Pieces:
    """A vocabulary with log-probabilities, found by the 64-bit hash of a substring."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, dtype=np.float64)
        self.longest = max(map(len, pieces), default=1)
        flat, lengths = _codes(pieces)
        ends = np.cumsum(lengths)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                on = lengths > k
                hashes[on] = hashes[on] * _BASE + flat[(ends - lengths)[on] + k].astype(np.uint64) + np.uint64(1)
            order = np.argsort(hashes)
            self.keys, self.ids = hashes[order], order
            self.maybe = np.zeros(1 << 20, dtype=bool)
            self.maybe[(self.keys * _MIX) >> np.uint64(44)] = True
            self.power = np.cumprod(np.array([1] + [int(_BASE)] * self.longest, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are pieces, and those pieces."""
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.maybe[(hashes * _MIX) >> np.uint64(44)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[spot] == hashes[at]
        return at[hit], self.ids[spot[hit]]

    def index(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces)}


class Trie:
    """The trie of distinct words of at most WIDE characters, level by level.

    ``edges[d]`` lists, for the nodes of depth d, (length, nodes, their ancestors at
    depth d - length, piece of the substring between); ``ends`` gives each word's depth
    and node.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        self.order = pc.sort_indices(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lengths = _codes([MARK + words[i] for i in self.order])
        deep = int(lengths.max(initial=0))
        self.depth, self.lengths, n = deep, lengths, len(words)
        begins = np.cumsum(lengths) - lengths
        changed = np.ones(n, dtype=bool)  # against the word before, up to this depth
        if n > 1:
            changed[1:] = False
        self.width, self.edges, self.bytes, self._up = [1], [[]], [np.zeros(1)], [None]
        node = [np.zeros(n, dtype=np.int32)]  # of each word, by depth
        hashes = [np.zeros(1, dtype=np.uint64)]
        for d in range(1, deep + 1):
            alive = lengths >= d
            own_char = np.zeros(n, dtype=np.uint32)
            own_char[alive] = flat[begins[alive] + d - 1]
            changed[1:] |= own_char[1:] != own_char[:-1]
            fresh = changed & alive
            start = np.flatnonzero(fresh)  # first word of each node
            node.append(np.cumsum(fresh, dtype=np.int32) - 1)
            char = own_char[start]
            with np.errstate(over="ignore"):
                own = hashes[d - 1][node[d - 1][start]] * _BASE + char.astype(np.uint64) + np.uint64(1)
                level = []
                for k in range(1, min(d, pieces.longest) + 1):
                    up = node[d - k][start]
                    at, piece = pieces.find(own - hashes[d - k][up] * pieces.power[k])
                    if len(at):
                        level.append((k, at, up[at], piece))
            hashes.append(own)
            self.width.append(len(start))
            self.edges.append(level)
            self.bytes.append(1.0 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
            self._up.append(node[d - 1][start])
        self.ends = np.zeros(n, dtype=np.int64)
        for d in range(1, deep + 1):
            on = lengths == d
            self.ends[on] = node[d][on]

    def forward(self, logp: np.ndarray) -> list[np.ndarray]:
        """Log of the summed probability of all segmentations of each prefix, by depth."""
        alpha = [np.zeros(1)]
        for d in range(1, self.depth + 1):
            a = alpha[d - 1][self._up[d]] + self.bytes[d] * BYTE_LOG
            for k, at, up, piece in self.edges[d]:
                a[at] = np.logaddexp(a[at], alpha[d - k][up] + logp[piece])
            alpha.append(a)
        return alpha

    def best(self, logp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Best score of each prefix and its number of pieces; equal scores take the fewer pieces."""
        score, count = [np.zeros(1)], [np.zeros(1)]
        for d in range(1, self.depth + 1):
            s = score[d - 1][self._up[d]] + self.bytes[d] * BYTE_LOG
            c = count[d - 1][self._up[d]] + self.bytes[d]
            for k, at, up, piece in self.edges[d]:
                s2, c2 = score[d - k][up] + logp[piece], count[d - k][up] + 1
                better = (s2 > s[at]) | ((s2 == s[at]) & (c2 < c[at]))
                s[at[better]], c[at[better]] = s2[better], c2[better]
            score.append(s)
            count.append(c)
        return score, count

    def at_words(self, levels: list[np.ndarray]) -> np.ndarray:
        """What each word's last node holds, in the order of the words given."""
        out = np.zeros(len(self.order))
        for d in range(1, self.depth + 1):
            on = self.lengths == d
            out[self.order[on]] = levels[d][self.ends[on]]
        return out

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each counted ``weight`` times."""
        alpha, total = self.forward(logp), np.zeros(len(logp))
        mass = [np.zeros(w) for w in self.width]
        for d in range(1, self.depth + 1):
            on = self.lengths == d
            mass[d] += np.bincount(self.ends[on], weight[self.order[on]], minlength=self.width[d])
        for d in range(self.depth, 0, -1):
            up = self._up[d]
            spelled = np.exp(alpha[d - 1][up] + self.bytes[d] * BYTE_LOG - alpha[d]) * mass[d]
            mass[d - 1] += np.bincount(up, spelled, minlength=self.width[d - 1])
            for k, at, anc, piece in self.edges[d]:
                used = np.exp(alpha[d - k][anc] + logp[piece] - alpha[d][at]) * mass[d][at]
                mass[d - k] += np.bincount(anc, used, minlength=self.width[d - k])
                total += np.bincount(piece, used, minlength=len(logp))
        return total


def _scalar(word: str, pieces: Pieces, index: dict[str, int]):
    """Edges of one word as (end, start, piece); piece -n is n bytes."""
    text = MARK + word
    for end in range(1, len(text) + 1):
        yield end, end - 1, -len(text[end - 1].encode("utf-8", "surrogatepass"))
        for start in range(max(0, end - pieces.longest), end):
            piece = index.get(text[start:end])
            if piece is not None:
                yield end, start, piece


def _log_add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def _weight(piece: int, logp) -> float:
    return piece * -BYTE_LOG if piece < 0 else float(logp[piece])


def _split(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    texts = words.to_pylist()
    wide = pc.utf8_length(words).to_numpy(zero_copy_only=False) > WIDE
    return texts, np.flatnonzero(~wide), np.flatnonzero(wide)


def word_log_probs(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Natural log of the marginal probability of each distinct word."""
    texts, short, wide = _split(words)
    out = np.zeros(len(texts))
    trie = Trie([texts[i] for i in short], pieces)
    out[short] = trie.at_words(trie.forward(pieces.logp))
    index = pieces.index() if len(wide) else {}
    for i in wide:
        alpha = [0.0] + [-math.inf] * (len(texts[i]) + 1)
        for end, start, piece in _scalar(texts[i], pieces, index):
            alpha[end] = _log_add(alpha[end], alpha[start] + _weight(piece, pieces.logp))
        out[i] = alpha[-1]
    return out


def word_piece_counts(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Pieces in the best segmentation of each distinct word."""
    texts, short, wide = _split(words)
    out = np.zeros(len(texts))
    trie = Trie([texts[i] for i in short], pieces)
    out[short] = trie.at_words(trie.best(pieces.logp)[1])
    index = pieces.index() if len(wide) else {}
    for i in wide:
        best = [(0.0, 0.0)] + [(-math.inf, 0.0)] * (len(texts[i]) + 1)
        for end, start, piece in _scalar(texts[i], pieces, index):
            s, c = best[start][0] + _weight(piece, pieces.logp), best[start][1] + (-piece if piece < 0 else 1)
            if s > best[end][0] or s == best[end][0] and c < best[end][1]:
                best[end] = (s, c)
        out[i] = best[-1][1]
    return out.astype(np.int64)


def expected_pieces(words: pa.Array, weight: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over words that occur ``weight`` times."""
    texts, short, wide = _split(words)
    total = Trie([texts[i] for i in short], pieces).expected(pieces.logp, weight[short])
    index = pieces.index() if len(wide) else {}
    for i in wide:
        edges = list(_scalar(texts[i], pieces, index))
        alpha = [0.0] + [-math.inf] * (len(texts[i]) + 1)
        for end, start, piece in edges:
            alpha[end] = _log_add(alpha[end], alpha[start] + _weight(piece, pieces.logp))
        mass = [0.0] * (len(texts[i]) + 1) + [float(weight[i])]
        for end, start, piece in reversed(edges):
            used = math.exp(alpha[start] + _weight(piece, pieces.logp) - alpha[end]) * mass[end]
            mass[start] += used
            if piece >= 0:
                total[piece] += used
    return total
