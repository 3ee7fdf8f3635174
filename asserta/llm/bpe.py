"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The vocabulary file (Hugging Face tokenizers' JSON: NFC, white space, lower case, one split pattern, byte-level BPE
with a word-end suffix) is read, never trained. A corpus pass finds frequent words; the driver encodes each once and
compiles them into a transducer: states that accept the same endings are shared, each edge carries a number, and the
sum of the numbers along a word's path is its place in a table of ids. The file goes to the shared folder and from
there to each executor once (SparkContext.addFile), and is memory-mapped, so its pages are shared by the Python workers
of a machine. A word that
the transducer doesn't accept is merged by the rules of the vocabulary; so the lexicon changes speed, never ids.

The lexicon is chosen by exact counts over all texts.

Edge cases: a null text is an empty one and has no ids. The strings of the special tokens in a text become their ids,
as the library does it by default. Rows are independent: repeated rows, null ids and other columns change nothing."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asserta.llm._common import chunks, written
from asserta.sources.workspace import new_path, put_file

LEXICON = 1 << 17  # frequent words compiled, at most
CACHED = 300_000  # words whose ids a Python worker keeps, if they are no longer than LONG bytes; it then starts afresh
LONG = 64
END = "</w>"
SHORT, NONE = 48, 1 << 62


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """What the JSON file says. Only the shape named above is understood; anything else raises ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        model, split = x["model"], x["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or x["decoder"] is not None or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} isn't a byte-level BPE with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in x["added_tokens"]}
        # Two ids in one number, and what they become: the rank above, the id below
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[self.ids[a] << 32 | self.ids[b]] = rank << 32 | self.ids[a + b]
        self.tokens = {i: t for t, i in {**self.ids, **self.added}.items()}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # The same over lower-cased ASCII, by the faster library
        self.ascii = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.start, self.ending = [self.ids[c] for c in byte_chars()], [self.ids[c + END] for c in byte_chars()]

    def words(self, text: str) -> list[str]:
        """The normalised text's words; each special token is one of its own, with NUL before it."""
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out.extend([f"\0{part}"] if k % 2 else self._plain(part))
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        # Lower-cased sign by sign: a sigma doesn't depend on what follows
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, word: str) -> list[int]:
        """A word's ids: the pair of least rank is merged, the leftmost first, until none is left. In a long word
        pairs wait in a heap and parts are linked, so it takes n log n steps."""
        if word[0] == "\0" and word[1:] in self.added:
            return [self.added[word[1:]]]
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.start[b] for b in raw]
        parts[-1] = self.ending[raw[-1]]
        if len(parts) > SHORT:
            return self._long(parts)
        get = self.pairs.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = least & (1 << 32) - 1
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 32 | b, NONE)) != NONE]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j], NONE) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = rank & (1 << 32) - 1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << 32 | parts[k], NONE)) != NONE:
                    heapq.heappush(waiting, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] << 32 | parts[i], NONE)) != NONE:
                heapq.heappush(waiting, (r, h))
        return [p for p in parts if p >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, the tokens' strings with spaces between; unknown ids are left out."""
        return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)


class Transducer:
    """Words to places in a table of ids. Arrays of a file, by struct header: edges' keys (state * 256 + byte,
    ascending), targets and outputs; each state's final flag; where each word's ids begin; the ids."""

    KINDS = ("<i8", "<i4", "<i4", "<i1", "<i8", "<u4")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            sizes = struct.unpack("<6q", f.read(48))
        at, parts = 48, []
        for kind, n in zip(self.KINDS, sizes):
            parts.append(np.asarray(np.memmap(path, kind, "r", at, (n,))) if n else np.zeros(0, kind))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.outputs, self.final, self.begin, self.ids = parts

    @classmethod
    def compile(cls, lexicon: dict[str, list[int]], path: str) -> None:
        """Daciuk's construction from sorted words: the part of the last path that the next word leaves is replaced
        by equal states already known."""
        words = sorted((w.encode(), w) for w in lexicon)
        edges: list[dict[int, int]] = [{}]
        final = [0]
        free: list[int] = []  # states that others took the place of
        known: dict[tuple, int] = {}
        path_of: list[int] = [0]
        last = b""

        def settle(down_to: int) -> None:
            while len(path_of) - 1 > down_to:
                state = path_of.pop()
                sign = (final[state], *edges[state].items())
                same = known.setdefault(sign, state)
                if same != state:
                    edges[path_of[-1]][last[len(path_of) - 1]] = same
                    free.append(state)

        for key, _ in words:
            common = len(os.path.commonprefix([last, key]))
            settle(common)
            for b in key[common:]:
                if free:
                    state = free.pop()
                    edges[state], final[state] = {}, 0
                else:
                    state = len(edges)
                    edges.append({})
                    final.append(0)
                edges[path_of[-1]][b] = state
                path_of.append(state)
            final[path_of[-1]] = 1
            last = key
        settle(0)
        # Words below each state, deepest first, then an edge's number: words passed over by taking it
        order: list[int] = []
        seen = {0}
        stack = [(0, iter(edges[0].values()))]
        while stack:
            state, rest = stack[-1]
            target = next((t for t in rest if t not in seen), None)
            if target is None:
                order.append(state)
                stack.pop()
            else:
                seen.add(target)
                stack.append((target, iter(edges[target].values())))
        number = {s: i for i, s in enumerate(reversed(order))}
        below: dict[int, int] = {}
        rows = []
        for s in order:
            passed = final[s]
            for b, t in sorted(edges[s].items()):
                rows.append((number[s] << 8 | b, number[t], passed))
                passed += below[t]
            below[s] = passed
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        flags = np.zeros(len(order), np.int8)
        flags[[number[s] for s in order]] = [final[s] for s in order]
        ids = [lexicon[w] for _, w in words]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) if ids else np.zeros(1, np.int64)
        parts = (table[:, 0], table[:, 1], table[:, 2], flags, begin, np.array([i for x in ids for i in x]))
        with open(path, "wb") as f:
            f.write(struct.pack("<6q", *map(len, parts)))
            for kind, part in zip(cls.KINDS, parts):
                f.write(part.astype(kind).tobytes().ljust(-(-len(part) * np.dtype(kind).itemsize // 8) * 8, b"\0"))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1 where it isn't accepted; all words step along together."""
        if not len(self.keys) or not words:
            return np.full(len(words), -1)
        n = np.array([len(w) for w in words])
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        state, place, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        out = np.full(len(words), -1)
        for step in range(int(n.max()) + 1):
            done = n[alive] == step
            ended = alive[done & (self.final[state[alive]] == 1)]
            out[ended] = place[ended]
            alive = alive[~done]
            if not len(alive):
                break
            key = state[alive] << 8 | data[at[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            alive, edge = alive[hit], edge[hit]
            state[alive] = self.targets[edge]
            place[alive] += self.outputs[edge]
        return out

    def ids_at(self, place: int) -> np.ndarray:
        return self.ids[self.begin[place] : self.begin[place + 1]]

    def all_ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places, and where each one's begin and the last end."""
        first = self.begin[places]
        at = np.concatenate([[0], np.cumsum(self.begin[places + 1] - first)])
        return self.ids[np.arange(at[-1]) + np.repeat(first - at[:-1], np.diff(at))], at


class Encoder:
    """A worker's vocabulary, transducer and a bounded store of words it has met: ids as bytes, and their tokens."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer | None):
        self.v, self.t = vocabulary, transducer
        self.met: dict[str, tuple[bytes, str]] = {}

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """What the words become."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        places = self.t.lookup(raw) if self.t else np.full(len(words), -1)
        tokens, made = self.v.tokens, {}
        if self.t and len(hit := np.flatnonzero(places >= 0)):
            ids, at = self.t.all_ids(places[hit])
            whole, names, edge = ids.tobytes(), [tokens[i] for i in ids.tolist()], at.tolist()
            for k, a, b in zip(hit.tolist(), edge, edge[1:]):
                made[words[k]] = (whole[4 * a : 4 * b], " ".join(names[a:b]))
        for k in np.flatnonzero(places < 0).tolist():
            own = self.v.merge(words[k])
            made[words[k]] = (struct.pack(f"<{len(own)}I", *own), " ".join([tokens[i] for i in own]))
        return made

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self.v.words(t) for t in texts]
        seen = set().union(*split)
        if len(self.met) + len(seen) > CACHED:
            self.met.clear()
        found = self.learn([w for w in seen if w not in self.met])
        long = {w: x for w, x in found.items() if len(w) > LONG}
        for w in long:
            del found[w]
        self.met.update(found)
        known = self.met | long if long else self.met
        for own in split:
            x = [known[w] for w in own]
            yield b"".join([ids for ids, _ in x]), " ".join([t for _, t in x])


@functools.lru_cache(1)
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(SparkFiles.get(name))


@functools.lru_cache(1)
def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    return Encoder(_vocabulary(vocabulary), Transducer(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, vocabulary: str, most: int = LEXICON) -> list[str]:
    """The most frequent words, all words of all texts being counted: those of the highest steps of frequency, eight
    to each doubling, that are `most` words together or fewer. docs has a column text. What reaches the driver is a
    row for each step, and `most` words."""
    name = _sent(docs, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name)
        for batch in batches:
            seen: Counter[str] = Counter()
            for _, piece in chunks(batch.column(0)):
                for text in piece.to_pylist():
                    seen.update(v.words(text))
            for special in [w for w in seen if w[0] == "\0"]:
                del seen[special]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    # Written, as it is read more than once
    totals = written(docs.select(F.col("text").alias("text_read")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2(F.col("n")) * 8)
    tally = sorted((tuple(r) for r in totals.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()), reverse=True)
    kept, least = 0, None
    for at, c in tally:
        if kept + c > most:
            break
        kept, least = kept + c, at
    return [r["word"] for r in totals.where(step >= least).select("word").toLocalIterator()] if kept else []


def _sent(docs: DataFrame, path: str) -> str:
    """Adds a file to the session's context; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def build_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON) -> str:
    """Compiles the transducer of the frequent words and sends it to the executors; its name there."""
    v = Vocabulary(vocabulary)
    words = frequent_words(docs, vocabulary, most)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, name)
        Transducer.compile({w: v.merge(w) for w in words}, local)
        path = new_path(docs.sparkSession, "lexicon")
        put_file(docs.sparkSession, local, f"{path}/{name}")
    return _sent(docs, f"{path}/{name}")


def encode(docs: DataFrame, vocabulary: str, keep: list[str], lexicon: str | None = None, with_ids: bool = False) -> DataFrame:
    """The columns `keep` of docs, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and
    decoded. docs has a column text; `keep` has none of the new names."""
    name, lexicon = _sent(docs, vocabulary), lexicon or build_lexicon(docs, vocabulary)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, lexicon)
        for batch in batches:
            for start, piece in chunks(batch.column(batch.num_columns - 1)):
                count, digest, text_digest, ids, decoded = [], [], [], [], []
                for raw, text in encoder.encode(piece.to_pylist()):
                    count.append(len(raw) // 4)
                    digest.append(hashlib.sha256(raw).hexdigest())
                    text_digest.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<i4"))
                        decoded.append(text)
                rest = [batch.column(i).slice(start, len(piece)) for i in range(batch.num_columns - 1)]
                made = [pa.array(count, pa.int64()), pa.array(digest), pa.array(text_digest)]
                made += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)] * with_ids
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*keep, *new])

    kept = [F.col(f"`{c}`") for c in keep]
    like = [F.lit(0).cast("long"), F.lit(""), F.lit("")] + [F.array(F.lit(0)), F.lit("")] * with_ids
    schema = docs.select(*kept, *[c.alias(n) for c, n in zip(like, new)]).schema
    return docs.select(*kept, F.col("text").alias("text_read")).mapInArrow(run, schema)
