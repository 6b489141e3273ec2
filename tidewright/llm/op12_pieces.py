"""SentencePiece encoding and decoding of whole texts by a prefix table of merge-type pieces.

A merge-type model joins the pair of neighbouring symbols whose text is the best-scored piece, the
leftmost of equals, until none is left. Whether two final pieces may stand side by side depends on
these two alone, and every prefix of a text has one last piece that fits what comes before it. So a
text needs no queue of merges: an automaton of all pieces gives, at each character, the pieces that
end there; the one that fits the last piece of the prefix before it is stored as this prefix's last
piece; and the ids are read off backwards from the end.

Two pieces fit if no merge across their border comes before one of the merges that made them. That is
tested by undoing the later of their last merges again and again, and asking whether the two symbols at
the border join to a piece that is better than what has been undone.

Model: merge type with byte fallback. Its bytes are read once on the driver, with the last merge of
each piece (two numbers a piece), and go to the tasks; executors need no file. Texts are normalised by
the library. Where no piece has a space sign after another character, texts are cut before space
signs, and around ASCII characters that no piece holds, and the ids of a stretch are remembered in a
table of at most ``MEMO`` stretches a worker, which saves time and changes no result.

Defined results: a null text is empty and has no ids; its decoded text is empty. Whole texts are
encoded, at any length, in memory proportional to the longest text. Characters that no piece holds
become byte pieces. Null ids, repeated rows and further columns are kept; columns called ``ids`` or
``decoded`` in any case are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.shared import without
from tidewright.llm.tokens import bytes_of, runs
from tidewright.sources.tables import table

#: Stretches of text whose ids a worker remembers; beyond it the table starts anew.
MEMO = 400_000
#: Stretches up to this many characters are remembered.
SHORT = 64
#: Pairs of pieces whose fit a worker remembers, and steps of the automaton that fall back.
PAIRS = STEPS = 1_000_000
#: The sign that stands for a space in pieces.
SPACE = "▁"
NONE = -1
#: Keys of a state of the automaton beside its characters.
FAIL, ENDS = 0, 1


class Merges:
    """The pieces of a model, their order, and the last merge that makes each."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.get_piece_size())
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        coded = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        if len(coded) != 256:
            raise ValueError("the model has no byte pieces")
        self.bytes = [coded[b] for b in range(256)]
        self.texts = [lib.id_to_piece(i) for i in every]
        self.number = {self.texts[i]: i for i in plain}
        places = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        #: Place of the merge that makes a piece: the smaller, the earlier. Single characters are not made.
        self.place = [places.get(lib.get_score(i), NONE) if len(self.texts[i]) > 1 else NONE for i in every]
        for c in sorted(set("".join(self.number)) - set(self.number)):  # symbols of merges that are no pieces
            self.number[c] = len(self.texts)
            self.texts.append(c)
            self.place.append(NONE)
        self.extra = len(self.texts) - len(every)
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole = [i for x, i in self.number.items() if len(x) == 1 or self._made(x, i)]
        #: Neighbouring characters within pieces.
        self.pairs = {x[k : k + 2] for x in self.number for k in range(len(x) - 1)}
        self.cuts = all(SPACE not in x.lstrip(SPACE) for x in self.number)

    def _made(self, text: str, number: int) -> bool:
        """Whether the merges of a piece's text end in the piece; keeps the last of them."""
        symbols = [self.number[c] for c in text]
        while len(symbols) > 1:
            joint = [self.number.get(self.texts[a] + self.texts[b], NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
            best = min((self.place[j], k) for k, j in enumerate([*joint, number]) if j != NONE)[1]
            if best == len(joint):
                return False  # what is left joins to nothing better: the piece is never made
            a, b, new = *symbols[best : best + 2], joint[best]
            if max(self.place[a], self.place[b]) > self.place[new]:
                raise ValueError(f"piece {self.texts[new]!r} comes before its parts")
            symbols[best : best + 2] = [new]
            if len(symbols) == 1:
                self.parts[number] = a, b
        return True


class Encoder:
    """Encodes texts with the pieces of ``Merges``.

    The automaton's states are dictionaries: by character the next state, at FAIL the state of the
    longest proper suffix, at ENDS the pieces that end here, the longest first, each with its length and
    what is known of the pieces that it fits. Steps that fall back are added as they are met.
    """

    def __init__(self, merges: Merges):
        self.m, self.steps, self.tested = merges, 0, 0
        self.root: dict = {}
        for i in merges.whole:
            at = self.root
            for c in merges.texts[i]:
                at = at.setdefault(c, {})
            at[ENDS] = ((i, len(merges.texts[i]), {NONE: True}),)
        level = [(self.root, c, to) for c, to in self.root.items()]
        self.root[FAIL], self.root[ENDS] = self.root, ()
        while level:
            deeper = []
            for parent, c, node in level:
                deeper += [(node, k, to) for k, to in node.items() if type(k) is str]
                at = parent[FAIL]
                while c not in at and at is not self.root:
                    at = at[FAIL]
                node[FAIL] = self.root if parent is self.root else at.get(c, self.root)
                node[ENDS] = node.get(ENDS, ()) + node[FAIL][ENDS]
            level = deeper
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in merges.number)
        self.lone = re.compile(f"([{lone}])") if lone else None
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.memo: tuple[dict, dict] = {}, {}  # of stretches with a space sign before them, and without
        self.old: tuple[dict, dict] = {}, {}

    def fit(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay side by side."""
        m, bound = self.m, len(self.m.texts) + 1
        while True:
            joint = m.number.get(m.texts[a] + m.texts[b], NONE)
            if joint != NONE and m.place[joint] < bound:
                return False
            if m.place[a] > m.place[b]:
                bound, a = m.place[a], m.parts[a][1]
            elif m.place[b] != NONE:  # of equals, the merge further left comes first, so b's is the later one
                bound, b = m.place[b] + 1, m.parts[b][0]
            else:
                return True

    def step(self, node: dict, c: str) -> dict:
        """The state after ``c`` where the trie of pieces has none."""
        at = node
        while c not in at and at is not self.root:
            at = at[FAIL]
        to = at.get(c, self.root)
        if self.steps < STEPS:
            self.steps += 1
            node[c] = to
        return to

    def table(self, text: str) -> list[int]:
        """For each prefix of ``text`` its last piece; NONE for a lone character."""
        last: list[int] = []
        put, state = last.append, self.root
        for end, c in enumerate(text):
            state = state.get(c) or self.step(state, c)
            for piece, n, known in state[ENDS]:
                if n > end:
                    break
                before = last[end - n]
                ok = known.get(before)
                if ok is None:
                    ok = self.fit(before, piece)
                    if self.tested < PAIRS:
                        self.tested += 1
                        known[before] = ok
                if ok:
                    break
            else:
                piece = NONE
            put(piece)
        return last

    def backwards(self, text: str) -> tuple[int, ...]:
        """The ids of a stretch, read off its prefix table from the end."""
        last, texts, pieces = self.table(text), self.m.texts, len(self.m.place) - self.m.extra
        ids, end = [], len(text) - 1
        while end >= 0:
            piece = last[end]
            if 0 <= piece < pieces:
                ids.append(piece)
                end -= len(texts[piece])
            else:
                ids += [self.m.bytes[b] for b in reversed(text[end].encode())]
                end -= 1
        return tuple(reversed(ids))

    def found(self, word: str, spaced: bool) -> tuple[int, ...]:
        """The ids of a stretch, remembered: what was met since the last two times the table was full."""
        ids = self.old[spaced].get(word)
        if ids is None and 1 < len(word) <= SHORT and word[-2:] not in self.m.pairs:  # no merge reaches over to the last character
            stem = word[:-1]
            ids = (self.memo[spaced].get(stem) or self.backwards(SPACE + stem if spaced else stem)) + self.backwards(word[-1])
        elif ids is None:
            ids = self.backwards(SPACE + word if spaced else word)
        if len(word) <= SHORT:
            if len(self.memo[1]) + len(self.memo[0]) >= MEMO:
                self.old, self.memo = self.memo, ({}, {})
            self.memo[spaced][word] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        """The ids of a normalised text."""
        if not self.m.cuts:
            return list(self.backwards(text))
        out: list[tuple[int, ...]] = []
        for part in self.lone.split(text) if self.lone else [text]:
            if SPACE * 2 in part or part[-1:] == SPACE:
                out += [self.found(s[1:], True) if s[0] == SPACE else self.found(s, False) for s in self.stretch.findall(part)]
                continue
            head, *words = part.split(SPACE)
            if head:
                out.append(self.memo[0].get(head) or self.found(head, False))
            ids = list(map(self.memo[1].get, words))
            if None in ids:
                ids = [x or self.found(w, True) for x, w in zip(ids, words, strict=True)]
            out += ids
        return list(chain.from_iterable(out))


@lru_cache(maxsize=1)
def tools(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, Encoder]:
    """The library, for normalising and decoding, and the encoder; once a worker."""
    return sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(Merges(model))


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded``, the text that these ids give back.

    ``model`` is a file that the driver can read. Rows stay where they are: there is no shuffle.
    """
    with open(model, "rb") as f:
        data = f.read()
    docs = without(docs, "ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, encoder = tools(data)
        for batch in batches:
            raw, offs = bytes_of(batch.column(batch.schema.get_field_index(text)))
            for i, j in runs(offs):
                flat, ends, shown = [], [0], []
                for k in range(i, j):
                    ids = encoder.ids(lib.normalize(raw[offs[k] : offs[k + 1]].tobytes().decode(errors="replace")))
                    shown.append(lib.decode(ids) if ids else "")
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists, pa.array(shown, pa.string())], names=[*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """The file of a public tokenizer; TIDEWRIGHT_TOKENIZERS names another folder of them."""
    if folder := os.environ.get("TIDEWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
