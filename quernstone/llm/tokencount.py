"""Token counts by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens, and each is segmented into the tokens of the
vocabulary whose log-probabilities add up to most (a unigram model). The score of
the best segmentation of a prefix does not depend on what follows; so distinct
pre-tokens go into a trie, each of whose nodes gets the forward score of its
prefix once, and the node where a pre-token ends has its count of tokens.

The vocabulary is a file of ranked byte strings. Ranks are no probabilities;
these are taken by Zipf's law, 1 / (rank + 1), normalised. Of equal scores the
segmentation of fewer tokens counts, then that with the longer last token.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernstone.llm.common import Memory, append_columns, worker_state
from quernstone.llm.fastbytes import PowerTable, mixed

#: Pre-tokens of a trie, and stretches of text whose counts a worker remembers; both bound its memory.
TRIE_WORDS = 50_000
REMEMBERED = 400_000
#: Bytes of a longer pre-token go through the recurrence one at a time, without a trie.
LONG = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def log_probabilities(path: str) -> dict[bytes, float]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    total = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - total for token, r in ranks.items()}


class PreTokenTrie:
    """Forward scores over the trie of a set of pre-tokens, a level at a time.

    Sorted, a pre-token adds the nodes beyond the prefix that it shares with the one
    before. Whether the bytes that lead to a node end in a token is looked up by a
    64-bit hash, once a node and size; the best sum over these is the node's score.
    """

    def __init__(self, scores: dict[bytes, float], trie_words: int = TRIE_WORDS):
        self.scores, self.trie_words = scores, trie_words
        self.longest = max(map(len, scores))
        self.powers = PowerTable()
        tokens = [t for t in scores if len(t) <= LONG]
        keys = np.zeros(len(tokens), np.uint64)
        self.sizes = np.unique([len(t) for t in tokens])
        for size in self.sizes.tolist():
            rows = [i for i, t in enumerate(tokens) if len(t) == size]
            flat = np.frombuffer(b"".join(tokens[i] for i in rows), np.uint8)
            keys[rows] = self._keys(self._sums(flat), np.arange(len(rows)) * size, size)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([scores[t] for t in tokens])[order]
        self.there = np.zeros(1 << 20, bool)  # by the upper bits of keys
        self.there[(keys >> np.uint64(44)).astype(np.intp)] = True
        self.nodes = 0

    def _sums(self, flat: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.powers.of(max(1, len(flat)))[0][: len(flat)], out=total[1:])
        return total

    def _keys(self, sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the size bytes from each of starts on."""
        return mixed((sums[starts + size] - sums[starts]) * self.powers.of(len(sums))[1][starts] + np.uint64(size))

    def counts(self, words: set[bytes]) -> dict[bytes, int]:
        """The tokens of the best segmentation of each word."""
        out = {w: self._long(w) for w in words if len(w) > LONG}
        rest = sorted(w for w in words if len(w) <= LONG)
        for at in range(0, len(rest), self.trie_words):
            part = rest[at : at + self.trie_words]
            out.update(zip(part, self._level_by_level(part)))
        return out

    def _level_by_level(self, words: list[bytes]) -> list[int]:
        """Of distinct sorted words, none of them empty."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths) - lengths
        shared = np.zeros(len(words), np.int64)  # bytes in common with the word before
        rows, depth = np.arange(1, len(words)), 0
        while len(rows):
            rows = rows[(lengths[rows] > depth) & (lengths[rows - 1] > depth)]
            rows = rows[flat[first[rows] + depth] == flat[first[rows - 1] + depth]]
            depth += 1
            shared[rows] = depth
        # places in flat stand for prefixes that end there; a shared one for the place that had it first
        level = np.arange(len(flat)) - np.repeat(first, lengths)
        fresh = level >= np.repeat(shared, lengths)
        by_level = np.argsort(level, kind="stable")
        node = np.empty(len(flat) + 1, np.int64)
        node[by_level] = by_level[np.maximum.accumulate(np.where(fresh[by_level], np.arange(len(flat)), 0))]
        node[-1] = len(flat)  # the root
        sums, found = self._sums(flat), []
        for size in self.sizes.tolist()[::-1]:  # longer last tokens first
            ends = np.flatnonzero(fresh & (level >= size - 1))
            if len(ends):
                keys = self._keys(sums, ends - (size - 1), size)
                some = self.there[(keys >> np.uint64(44)).astype(np.intp)]
                ends, keys = ends[some], keys[some]
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                some = self.keys[at] == keys
                ends, at = ends[some], at[some]
                before = np.where(level[ends] >= size, node[ends - size], len(flat))
                found.append((level[ends], ends, before, self.values[at]))
        best, count = np.full(len(flat) + 1, -np.inf), np.zeros(len(flat) + 1, np.int64)
        best[-1] = 0
        if found:
            depth, ends, before, score = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(depth, kind="stable")  # within a level by size, the longest first
            cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = order[a:b]
                total, n = score[rows] + best[before[rows]], count[before[rows]] + 1
                ranked = np.lexsort((n, -total, ends[rows]))  # stable, so the longest of equals stays first
                own = ends[rows][ranked]
                lead = ranked[np.concatenate(([True], own[1:] != own[:-1]))]
                best[ends[rows][lead]], count[ends[rows][lead]] = total[lead], n[lead]
        self.nodes = int(fresh.sum())
        return count[node[first + lengths - 1]].tolist()

    def _long(self, word: bytes) -> int:
        """The same without a trie; the scores of only so many prefixes are held as
        a next token can begin at."""
        scores, longest = self.scores, self.longest
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, fewest = -math.inf, 0
            for size in range(min(end, longest), 0, -1):
                s = scores.get(word[end - size : end])
                if s is not None:
                    s += best[-size]
                    n = count[-size] + 1
                    if s > top or s == top and n < fewest:
                        top, fewest = s, n
            best.append(top)
            count.append(fewest)
            if len(best) > 2 * longest:
                del best[:-longest], count[:-longest]
        return count[-1]


class TokenCounter:
    """Pre-tokens and tokens of texts, by stretches that single spaces part.

    A pre-token takes one space before it along, and none has a space inside but
    runs of white space. So where a stretch neither begins nor ends with white
    space, it and the space before it can be counted apart, and each distinct one
    of many texts once. Texts with other stretches are counted whole.
    """

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex

        self.pre_tokens = regex.compile(pattern).findall
        self.trie = PreTokenTrie(log_probabilities(path))
        self.memory = Memory(remembered)

    def _counts(self, stretches: list[str]) -> list[int]:
        """Of each stretch: tokens above bit 32, pre-tokens below."""
        found = [self.pre_tokens(x) for x in stretches]
        words = set().union(*found)
        tokens = dict(zip(words, map(str.encode, words)))
        known = self.trie.counts(set(tokens.values()))
        tokens = {k: known[v] for k, v in tokens.items()}
        return [sum(map(tokens.__getitem__, each)) << 32 | len(each) for each in found]

    def _learn(self, stretches: list[str]) -> list[int]:
        """Of stretches after a space; -1 for those that can't be counted apart."""
        apart = [i for i, x in enumerate(stretches) if x and not x[0].isspace() and not x[-1].isspace()]
        out = [-1] * len(stretches)
        for i, n in zip(apart, self._counts([" " + stretches[i] for i in apart])):
            out[i] = n
        return out

    def count(self, column: pa.Array) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each string; null is empty."""
        column = pc.fill_null(column, "")
        parts = pc.split_pattern(column, " ")
        words = parts.flatten().dictionary_encode()
        ends = parts.value_lengths().to_numpy().cumsum()
        starts = ends - parts.value_lengths().to_numpy()
        value = np.array(self.memory.known(words.dictionary.to_pylist(), self._learn), np.int64)
        value = value[words.indices.to_numpy()]
        total = np.add.reduceat(value, starts) if len(starts) else starts
        apart = np.logical_and.reduceat(value >= 0, starts) if len(starts) else starts
        # the first stretch has no space before it
        strings = [x[: x.find(" ")] if ok and " " in x else x for x, ok in zip(column.to_pylist(), apart.tolist())]
        total = np.where(apart, total - (value[starts] if len(starts) else 0), 0) + np.array(self._counts(strings), np.int64)
        return (total & 0xFFFFFFFF).tolist(), (total >> 32).tolist()


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_text: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """docs with n_pretokens and n_tokens of the whole text.

    A null or empty text has none of either. Equal texts get equal counts, however
    long; a table without rows gives none. A column of docs whose name is that of
    a new column is replaced.
    """
    path, pattern = path or vocabulary_path(), pattern or pre_token_pattern()
    fields = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def make():
        counter = worker_state("tokens", (path, pattern, remembered), lambda: TokenCounter(path, pattern, remembered))
        return lambda batch: counter.count(batch.column(batch.schema.get_field_index("text")))

    return append_columns(docs, fields, make, () if keep_text else ("text",), stateful=True)
