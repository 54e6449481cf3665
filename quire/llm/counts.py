"""Token counts of a unigram tokenizer without tokenizing: Viterbi that carries score and piece count only.

Text is cut before every space (a space, or U+2581, becomes U+2581; one is put in front if the text
does not begin with it), which is where no piece can cross. An Aho-Corasick automaton over the
vocabulary enumerates all pieces that end at each character; dynamic programming keeps the best
score, its number of pieces and whether it ends in an unknown piece.

Tie rules of the tokenizer: candidates for an end come in order of their start, and only a strictly
better score replaces one, so among equal ones the longest last piece stays. A character that is no
piece by itself may be unknown at the lowest score minus 10; adjacent unknown ones are one piece.
Scores are double.

Different words of a chunk (told apart by their bytes) are counted once, many at a time as numpy
columns, and kept for the task's next chunks up to a fixed number. A very long text is taken in parts
cut at spaces. A text's score is summed over its own words only, so equal texts get equal scores.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_table, chunks, dictionary, parts, spaced, text_bytes

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words longer than this are counted one by one; words counted together; words kept by a task.
LONG_WORD, TOGETHER, KEPT = 64, 1 << 14, 1 << 18

_BREAK = byte_table((0x20, 0x20))


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log-probability) of the ordinary pieces of a sentencepiece file.

    A unigram model's scores are log-probabilities as they are. A file of another model orders its
    pieces only, and the k-th gets the probability that Zipf's law gives it, 1 / (k * H).
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if schema.ModelProto.FromString(m.serialized_model_proto()).trainer_spec.model_type == schema.TrainerSpec.UNIGRAM:
        return rows
    rows.sort(key=lambda r: -r[1])
    whole = math.log(sum(1 / k for k in range(1, len(rows) + 1)))
    return [(piece, -math.log(k) - whole) for k, (piece, _) in enumerate(rows, 1)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Automaton:
    """Aho-Corasick over code points as arrays: transitions in a hash table, failure and output links."""

    def __init__(self, pieces: list[tuple[str, float]]):
        goto: list[dict[str, int]] = [{}]
        self_len, self_score = [0], [0.0]
        for piece, score in pieces:
            at = 0
            for c in piece:
                nxt = goto[at].get(c)
                if nxt is None:
                    nxt = goto[at][c] = len(goto)
                    goto.append({})
                    self_len.append(0)
                    self_score.append(0.0)
                at = nxt
            if at:
                self_len[at], self_score[at] = len(piece), score
        n = len(goto)
        fail, link = [0] * n, [0] * n
        queue = deque(goto[0].values())
        while queue:
            at = queue.popleft()
            link[at] = fail[at] if self_len[fail[at]] else link[fail[at]]
            for c, nxt in goto[at].items():
                f = fail[at]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[nxt] = goto[f].get(c, 0)
                queue.append(nxt)
        self.goto, self.fail_list, self.link_list, self.len_list, self.score_list = goto, fail, link, self_len, self_score
        self.fail, self.link = np.array(fail, np.int32), np.array(link, np.int32)
        self.length, self.score = np.array(self_len, np.int32), np.array(self_score)
        self.first = np.where(self.length > 0, np.arange(n), self.link).astype(np.int32)
        scores = [s for _, s in pieces]
        self.unknown = (min(scores) if scores else 0.0) - UNKNOWN_PENALTY
        keys = np.array([at << 21 | ord(c) for at, d in enumerate(goto) for c in d], np.int64)
        values = np.array([v for d in goto for v in d.values()], np.int32)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self._fill(keys, values)
        top = np.zeros(0x110000, np.int32)
        for c, v in goto[0].items():
            top[ord(c)] = v
        self.root = top

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probing; self.probes is the longest run of steps any key needs."""
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(left):
            free = self.keys[at] == -1
            spot, who = np.unique(at[free], return_index=True)
            rows = left[free][who]
            self.keys[spot], self.values[spot] = keys[rows], values[rows]
            done = np.isin(left, rows)
            left, at = left[~done], at[~done]
            if len(left):
                at = (at + 1) % size
                self.probes += 1

    def lookup(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states, or -1."""
        key = state.astype(np.int64) << 21 | char
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], -1)
        todo = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (1 << self.bits) - 1
            got = self.keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = np.where(state == 0, self.root[char], 0)
        todo = np.flatnonzero(state)
        at = state[todo]
        while len(todo):
            nxt = self.lookup(at, char[todo])
            ok = nxt >= 0
            out[todo[ok]] = nxt[ok]
            todo, at = todo[~ok], self.fail[at[~ok]]
            low = at == 0
            out[todo[low]] = self.root[char[todo[low]]]
            todo, at = todo[~low], at[~low]
        return out

    def many(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and piece counts of words, rows of a matrix of code points sorted by falling length."""
        n, width = chars.shape
        best, count = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int64)
        tail = np.zeros((width + 1, n), bool)
        best[0] = 0
        state = np.zeros(n, np.int32)
        for p in range(width):
            live = int(np.searchsorted(-size, -p, "left"))  # rows longer than p
            state = self.step(state[:live], chars[:live, p])
            cur, rows = self.first[state], np.arange(live)
            single = np.zeros(live, bool)
            b, k, t = best[p + 1], count[p + 1], tail[p + 1]
            some = cur > 0
            cur, rows = cur[some], rows[some]
            while len(rows):
                start = p + 1 - self.length[cur]
                score = best[start, rows] + self.score[cur]
                win = score > b[rows]
                r = rows[win]
                b[r], k[r], t[r] = score[win], count[start[win], r] + 1, False
                single[rows[start == p]] = True
                cur = self.link[cur]
                some = cur > 0
                cur, rows = cur[some], rows[some]
            rows = np.flatnonzero(~single)
            if len(rows):
                score = best[p, rows] + self.unknown
                r = rows[score > b[rows]]
                b[r], k[r], t[r] = score[score > b[rows]], count[p, r] + ~tail[p, r], True
        at = np.arange(n)
        return best[size, at], count[size, at]

    def one(self, word: str) -> tuple[float, int]:
        """The same for one word of any length, in memory of the longest piece's order."""
        keep = max(self.len_list) + 1
        best, count, tail = deque([0.0], keep), deque([0], keep), deque([False], keep)
        state = 0
        for c in word:
            while state and c not in self.goto[state]:
                state = self.fail_list[state]
            state = self.goto[state].get(c, 0)
            b, k, t, single = -np.inf, 0, False, False
            cur = state if self.len_list[state] else self.link_list[state]
            while cur:
                n = self.len_list[cur]
                score = best[-n] + self.score_list[cur]
                if score > b:
                    b, k, t = score, count[-n] + 1, False
                single |= n == 1
                cur = self.link_list[cur]
            if not single and best[-1] + self.unknown > b:
                b, k, t = best[-1] + self.unknown, count[-1] + (not tail[-1]), True
            best.append(b)
            count.append(k)
            tail.append(t)
        return best[-1], count[-1]


_AUTOMATA: dict[str, Automaton] = {}


class Counter:
    def __init__(self, path: str | None, pieces: list[tuple[str, float]] | None = None):
        if pieces is None:
            if path not in _AUTOMATA:
                _AUTOMATA[path] = Automaton(load_vocabulary(path))
            self.automaton = _AUTOMATA[path]
        else:
            self.automaton = Automaton(pieces)
        self.known: dict[bytes, tuple[float, int]] = {}

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        score, count = np.empty(len(words)), np.empty(len(words), np.int64)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            score[i], count[i] = self.automaton.one(words[i])
        short = np.flatnonzero(size <= LONG_WORD)
        order = short[np.argsort(-size[short], kind="stable")]
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            n = size[rows]
            flat = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
            chars = np.zeros((len(rows), int(n[0])), np.int64)
            chars[np.arange(chars.shape[1])[None, :] < n[:, None]] = flat
            score[rows], count[rows] = self.automaton.many(chars, n)
        return score, count

    def forms(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of different words, given without their spaces."""
        if len(self.known) > KEPT:
            self.known.clear()
        score, count = np.empty(len(forms)), np.empty(len(forms), np.int64)
        new = []
        for k, w in enumerate(forms):
            got = self.known.get(w)
            if got is None:
                new.append(k)
            else:
                score[k], count[k] = got
        if new:
            score[new], count[new] = self.words([SPACE + forms[k].decode() for k in new])
            self.known.update({forms[k]: (score[k], count[k]) for k in new if len(forms[k]) <= LONG_WORD})
        return score, count

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, pretokens and score of each text."""
        mark = SPACE.encode()
        if mark in text_bytes(col)[0].tobytes():  # the mark in a text is a space
            col = pa.array([(t or "").replace(SPACE, " ") for t in col.to_pylist()], pa.large_string())
        off = text_bytes(col)[1]
        tokens, words, score = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64), np.zeros(len(col))
        for p in parts(col, _BREAK):
            index, forms = dictionary(*spaced(p.data, p.s, p.e))
            each, n = self.forms([*forms, b""])
            # a pretoken begins at every space, and at a text's first byte; those without a word are a mark alone
            spaces = np.concatenate([[0], np.cumsum(p.data == 0x20)])
            at = off if len(p.rows) != 1 else np.array([0, len(p.data)])
            begins = spaces[at[1:]] - spaces[at[:-1]]
            full = np.flatnonzero(np.diff(at))
            begins[full] += (p.data[at[:-1][full]] != 0x20) & (p.start == 0)
            worded = np.flatnonzero(p.own)
            if len(worded):
                begin = p.first[:-1][worded]
                tokens[p.rows[worded]] += np.add.reduceat(n[index], begin)
                score[p.rows[worded]] += np.add.reduceat(each[index], begin)
            words[p.rows] += begins
            tokens[p.rows] += (begins - p.own) * n[-1]
            score[p.rows] += (begins - p.own) * each[-1]
        return tokens, words, score


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_words, score for every row, over its whole text.

    vocabulary is a sentencepiece file read on the executors, or pieces are given as (piece, score).
    n_words counts the stretches between spaces, score is the sum of the best paths' scores. Null
    and empty texts have 0 of all. Repeated rows stay, equal texts get equal values; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    path = None if pieces else vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pieces)
        for b in chunks(batches):
            tokens, words, score = counter(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_words", "score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_words long, score double")
