"""BPE encoding by a trie of words, and decoding.

A worker inserts the distinct words that it meets into a trie and gives each node, depth first, the last token of the encoding of
the prefix that it stands for. Prefixes that words share are so worked out once. A node's last token is the one token t that the
prefix ends with and that may follow the last token of the node where t begins; a word's encoding is read backwards, from the token
at its end to the nodes where each begins.

Why this is exact, for a vocabulary whose merges each make a token of their own, after the merges that make their parts, and whose
tokens, encoded alone, end as themselves (checked as a vocabulary is loaded): a merge across the place where two tokens of an
encoding meet would have been made if one had been possible while both its parts stood there, and no other token has a say in that.
So tokens are an encoding if, and only if, each two neighbours are one by themselves; the beginning of an encoding is the encoding
of that beginning, and just one last token fits it. `may_follow` looks at the two places where they meet: the parts of the left
token that end there, one inside the other, and those of the right token that begin there. Parts x and y are joined if their merge
comes before the merge that takes x into a longer part, and not after the one that takes y (of equal ranks the leftmost is first).

Texts are cut at ASCII white space, as neither the normaliser nor the pre-tokenizer's pattern reaches across it; of the pieces,
distinct ones alone are normalised and cut into words, by the library's own normaliser and pre-tokenizer. Strings of added tokens
become their ids wherever they stand, as is the library's default. A worker holds twice MEMO pieces and MOST_NODES nodes, and what one
stretch of texts (PART bytes, or one text) adds to them, at most; what it holds changes its speed alone.

Decoding writes the tokens' strings with blanks between, as the library does for vocabularies that name no decoder. What is encoded
here is decoded by the same worker: Spark gives each Python step of a task a worker of its own, and in time every one of them would
hold all tables. A worker that only decodes holds the strings alone.

Defined results: null text is empty and has no tokens; every row is encoded by itself, so that rows and ids may repeat or be null;
an empty table gives an empty result; the columns to carry come back in one struct, so that clashing names do no harm.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import as_bytes, stretches, whole

MEMO, MOST_NODES, MOST_PAIRS = 300_000, 300_000, 250_000
#: Bytes of text (or ids) that are worked on at a time.
PART = 2_000_000
NEVER = 1 << 60
#: Of this normaliser and this pre-tokenizer it is known what they make of ASCII letters and marks after them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_plain = re.compile(rb"([A-Za-z]+)([.,;:!?]*)")


def strings_of(spec: dict) -> dict[int, str]:
    """The string of each id of a tokenizers file."""
    if spec.get("decoder"):
        raise ValueError("a vocabulary with a decoder of its own")
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or []}


class Vocabulary:
    """Tokens, merges and spines of a tokenizers file; a word is a string of the vocabulary's characters without its end mark."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec.get("added_tokens") or []
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain BPE vocabulary")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on what surrounds them")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.letters = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
        self.strings = strings_of(spec)
        self.mark = model.get("end_of_word_suffix") or ""
        self._tokens(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.pairs: dict[tuple[int, int], bool] = {}

    def _tokens(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> None:
        ranks = {a + b: i for i, (a, b) in enumerate(merges)}
        if len(ranks) < len(merges) or any(ranks.get(x, -1) >= i for i, pair in enumerate(merges) for x in pair) or not ranks.keys() <= ids.keys():
            raise ValueError("merges that make the same token, or parts after the whole")
        self.rank = {(ids[a], ids[b]): i for i, (a, b) in enumerate(merges)}
        # of each token its parts at one end, from the whole inwards, each with the rank of the merge that takes it in
        ends: dict[int, list[tuple[int, int]]] = {}
        starts: dict[int, list[tuple[int, int]]] = {}
        made, single = [], len(self.mark)
        for t, i in ids.items():
            if t not in ranks and len(t.removesuffix(self.mark) if single else t) == 1:
                ends[i] = starts[i] = [(i, NEVER)]
                made.append(t)
        for k, (a, b) in enumerate(merges):
            whole_token, left, right = ids[a + b], ids[a], ids[b]
            if left not in ends or right not in ends or any((x, y) != (left, right) and self._meets(x, y, taken, kept) for x, taken in ends[left] for y, kept in starts[right]):
                raise ValueError("a token that isn't its own encoding")
            ends[whole_token] = [(whole_token, NEVER), (right, k), *ends[right][1:]]
            starts[whole_token] = [(whole_token, NEVER), (left, k), *starts[left][1:]]
            made.append(a + b)
        self.ends, self.starts = ends, starts
        self.inner = {t: ids[t] for t in made if not single or not t.endswith(self.mark)}
        self.final = {t.removesuffix(self.mark): ids[t] for t in made if t.endswith(self.mark)} if single else self.inner
        # lengths of the tokens, the longest first, that may end a word that ends with given four characters; filled as they come up
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)

    def _sizes(self, tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        long: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) >= 4:
                long.setdefault(t[-4:], set()).add(len(t))
        return {end: (*sorted(sizes, reverse=True), *self.short_sizes(end, tokens)) for end, sizes in long.items()}

    @staticmethod
    def short_sizes(end: str, tokens: dict[str, int]) -> tuple[int, ...]:
        """Which of the last three, two and one characters are tokens."""
        return tuple(n for n in (3, 2, 1) if n <= len(end) and end[-n:] in tokens)

    def _meets(self, x: int, y: int, taken: int, kept: int) -> bool:
        m = self.rank.get((x, y))
        return m is not None and m < taken and m <= kept

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two are the encoding of their joined strings."""
        known = self.pairs.get((left, right))
        if known is None:
            known = not any(self._meets(x, y, taken, kept) for x, taken in self.ends[left] for y, kept in self.starts[right])
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known


class Trie:
    """Prefixes of words, each with the last token of its encoding. Node 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[tuple[int, str], int] = {}
        self.last, self.length = array("q", [-1]), array("q", [0])

    def _last(self, word: str, end: int, path: list[int], tokens: dict[str, int], sizes: dict[str, tuple[int, ...]]) -> tuple[int, int]:
        """The token that ends the encoding of word[:end], and its length. path: the nodes of the shorter prefixes."""
        tail = word[end - 4 : end] if end > 4 else word[:end]
        found = sizes.get(tail)
        if found is None:
            if len(sizes) >= MOST_PAIRS:
                sizes.clear()
                sizes.update(self.vocabulary._sizes(tokens))
            found = sizes[tail] = self.vocabulary.short_sizes(tail, tokens)
        last, known = self.last, self.vocabulary.pairs
        for size in found:
            if size >= end:
                if size == end and word[:end] in tokens:
                    return tokens[word[:end]], end
                continue
            t = tokens.get(word[end - size : end])
            if t is not None:
                pair = (last[path[end - size]], t)
                fits = known.get(pair)
                if self.vocabulary.may_follow(*pair) if fits is None else fits:
                    return t, size
        raise ValueError(f"no token for {word[end - 1]!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word. In sorted order the words walk the trie depth first: the nodes on the way to a word stay while the words
        below them come, and each new node gets its last token from those above it."""
        v, found, child, last, length = self.vocabulary, {}, self.child, self.last, self.length
        inner, final, inner_sizes, final_sizes, last_of = v.inner, v.final, v.inner_sizes, v.final_sizes, self._last
        path, before = [0], ""
        for word in sorted(words):
            shared, size = 0, len(word)
            most = min(len(before), size - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            node = path[-1]
            for end in range(shared + 1, size):
                key = (node, word[end - 1])
                node = child.get(key)
                if node is None:
                    token, n = last_of(word, end, path, inner, inner_sizes)
                    node = child[key] = len(last)
                    last.append(token)
                    length.append(n)
                path.append(node)
            token, n = last_of(word, size, path, final, final_sizes)
            ids, at = [token], size - n
            while at:
                ids.append(last[path[at]])
                at -= length[path[at]]
            ids.reverse()
            found[word] = ids
            before = word
        return found


class Encoder:
    """Ids of texts, with a worker's trie and its table of pieces: the younger half of it, and the older, from which what is met again
    comes back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.trie, self.memo, self.old = Trie(self.vocabulary), {}, {}

    def _words(self, piece: bytes) -> list[str | int]:
        """A piece's words in order, and ids where strings of added tokens stand."""
        v, out, text = self.vocabulary, [], piece.decode()
        for part in v.cut.split(text) if v.cut else [text]:
            if part in v.added:
                out.append(v.added[part])
            elif part:
                plain = v.normalizer.normalize_str(part) if v.normalizer else part
                out += [w for w, _ in v.pre_tokenizer.pre_tokenize_str(plain)] if v.pre_tokenizer else [plain]
        return [w for w in out if w != ""]

    def _encoded(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that aren't in the younger half. A piece of letters and marks is its word's ids and its marks'."""
        if len(self.trie.last) > MOST_NODES:
            self.trie = Trie(self.vocabulary)
        found: dict[bytes, bytes] = {}
        plain: list[tuple[bytes, bytes, bytes]] = []
        other: dict[bytes, list[str | int]] = {}
        new: set[str] = set()
        for p in pieces:
            if p in self.old:
                found[p] = self.old[p]
            elif self.vocabulary.letters and (parts := _plain.fullmatch(p)):
                word, marks = parts.groups()
                word = word.lower()
                plain.append((p, word, marks))
                for x in (word, marks) if marks else (word,):
                    if x not in found:
                        ids = self.memo.get(x) or self.old.get(x)
                        if ids is None:
                            new.add(x.decode())
                        else:
                            found[x] = ids
            else:
                other[p] = self._words(p)
                new.update(w for w in other[p] if isinstance(w, str))
        ids_of = {w: array("I", ids).tobytes() for w, ids in self.trie.encode(new).items()}
        for p, word, marks in plain:
            for x in (word, marks) if marks else (word,):
                if x not in found:
                    found[x] = ids_of[x.decode()]
            found[p] = found[word] + found[marks] if marks else found[word]
        for p, words in other.items():
            found[p] = b"".join(ids_of[w] if isinstance(w, str) else array("I", [w]).tobytes() for w in words)
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as unsigned 32-bit numbers of the machine's order."""
        memo, pieces = self.memo, [t.split() for t in texts]
        memo.update(self._encoded(list({p for own in pieces for p in own if p not in memo})))
        out = [b"".join(map(memo.__getitem__, own)) for own in pieces]
        if len(memo) > MEMO:
            self.memo, self.old = {}, memo
        return out


@contextmanager
def without_cycles() -> Iterator[None]:
    """No search for cycles of references meanwhile: the tables hold none, and going through them again and again takes a fifth of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_loaded: dict[str, Encoder] = {}
_strings: dict[str, dict[int, str]] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def strings(path: str) -> dict[int, str]:
    """The string of each id, without the tables that encoding takes."""
    if path in _loaded:
        return _loaded[path].vocabulary.strings
    if path not in _strings:
        with open(path, encoding="utf-8") as file:
            _strings[path] = strings_of(json.load(file))
    return _strings[path]


def _little_endian(ids: bytes) -> bytes:
    import sys

    if sys.byteorder == "little":
        return ids
    swapped = array("I", ids)
    swapped.byteswap()
    return swapped.tobytes()


def decode(ids: bytes, strings: dict[int, str]) -> str:
    """The tokens' strings with blanks between; ids: unsigned 32-bit, little-endian."""
    return " ".join(map(strings.__getitem__, array("I", _little_endian(ids))))


def encoded(df: DataFrame, carry: list[str], tokenizer_path: str, text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """Columns row (a struct of the columns `carry`) and ids (binary: unsigned 32-bit, little-endian) of every row; with_decoded: and
    the text that they stand for, as column decoded, made in the same pass."""
    given = df.select(F.struct(*carry).alias("row"), whole(text_col).alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if with_decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for a, b in stretches(sizes, PART):
                part = batch.slice(a, b - a)
                with without_cycles():
                    ids = [_little_endian(x) for x in own.ids(as_bytes(part.column("text")))]
                texts = [pa.array([decode(x, own.vocabulary.strings) for x in ids], pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.binary()), *texts], schema.names)

    return given.mapInArrow(run, schema)


def decoded(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """df, with columns row and ids, and the text that the ids stand for as column decoded; null where ids is null."""
    given = df.select("row", "ids")
    schema = T.StructType([*given.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = strings(tokenizer_path)
        for batch in batches:
            sizes = [x or 0 for x in pc.binary_length(batch.column("ids")).to_pylist()]
            for a, b in stretches(sizes, PART):
                part = batch.slice(a, b - a)
                texts = [None if x is None else decode(x, of) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    return given.mapInArrow(run, schema)
