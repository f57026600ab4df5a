"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as `<|turn|>role<|text|>text<|end|>` per turn. Inside roles and texts `\\` becomes `\\\\` and
`<|` becomes `<\\|`, so no control string can stand there and the way back is unique. The control strings are added
to the tokenizer as tokens of their own, so no token lies across the edge of a text. The whole rendering is encoded
once with offsets; a token's loss mask is set where its span meets the span of an assistant's text, found by binary
search in the sorted turn spans.

Rows are dealt by conversation and sorted by turn; a task streams over them and holds one piece of a conversation at
a time. A conversation over more than one stretch of `piece_turns` turn numbers is dealt by stretch, so one with a
third of all rows is rendered, encoded and masked by many tasks; stretches with more than `piece_chars` characters
come as several rows. All cuts are between turns, where the tokens are cut anyway. A digest is a chain over a
conversation's turns and so is made in one task, from the pieces' texts, which are all that it gets; a conversation in
one stretch is finished where it was formatted.

Null texts and roles are empty. Rows of one conversation with the same turn are ordered by role and text; null ids
are one conversation, null turns come first. Other columns are not read. An empty table gives an empty result.

The vocabulary is a file of ranks (`.tiktoken`) or of the tokenizers library (`.json`); both give the same tokens of
the same vocabulary, but that runs of over 50,000 white spaces are encoded in pieces by the former.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

# The control strings of the template, and the pattern that parts a text before byte-level merges.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FORMATTED = "conv_id string, part long, whole boolean, piece int, n_turns long, rendered string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
PARTS = f"{READ}, part long, piece int, turns_text binary, loss_text binary"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, np.ndarray]:
    """The rendering of (role, text) turns and the (start, end) spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


@cache
def _encoder(path: str) -> Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function from a rendering to its tokens' ids, starts and ends (in characters)."""
    return _from_ranks(path) if path.endswith(".tiktoken") else _from_json(path)


def _from_json(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])

    def encode(text: str):
        e = t.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
        return np.array(e.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1]

    return encode


def _from_ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    top = max(ranks.values()) + 2  # one id is free for an end of text
    special = {x: top + k for k, x in enumerate((TURN, TEXT, END))}
    t = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    width = np.zeros(top + 3, dtype=np.int32)
    for token, rank in [*ranks.items(), *((x.encode(), k) for x, k in special.items())]:
        width[rank] = len(token)

    def ids_of(text: str) -> np.ndarray:
        try:
            return t.encode_to_numpy(text, allowed_special="all").astype(np.int32)
        except ValueError:  # the pattern's stack is too small for a long run of white space
            cuts = [0, *(m.end() for m in re.finditer(r"\s{50000}", text)), len(text)]
            if len(cuts) == 2:
                raise
            return np.concatenate([t.encode_to_numpy(text[a:b], allowed_special="all").astype(np.int32) for a, b in zip(cuts, cuts[1:])])

    def encode(text: str):
        ids, raw = ids_of(text), text.encode("utf-8")
        ends = np.cumsum(width[ids], dtype=np.int32)
        starts = ends - width[ids]
        if len(raw) != len(text):  # bytes to characters: a token of a character's part has all of it
            begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
            upto = np.concatenate([[0], np.cumsum(begins, dtype=np.int32)])
            starts, ends = (upto[starts + 1] - 1).astype(np.int32), upto[ends].astype(np.int32)
        return ids, starts, ends

    return encode


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token span meets a turn span: the last turn that begins before the token's end must end after
    its start."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    k = np.searchsorted(spans[:, 0], ends, side="left") - 1
    return (k >= 0) & (spans[np.maximum(k, 0), 1] > starts)


def _formatter(tokenizer: str, piece_chars: int):
    names = [x.split()[0] for x in FORMATTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        at, piece, turns, size, out, held = None, 0, [], 0, [], 0

        def flush():
            nonlocal piece, turns, size, held
            text, spans = render(turns)
            ids, starts, ends = encode(text)
            out.append((*at, piece, len(turns), text, ids, starts, ends, loss_mask(starts, ends, spans)))
            piece, turns, held, size = piece + 1, [], held + len(text), 0

        def rows() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=names)
            out.clear()
            return df

        for batch in batches:
            for c, part, whole, role, text in zip(*(batch[x] for x in ("conv_id", "part", "whole", "role", "text"))):
                if turns and ((c, part, whole) != at or size >= piece_chars):
                    flush()
                    if held >= 4_000_000:
                        yield rows()
                        held = 0
                if (c, part, whole) != at:
                    piece = 0
                at = (c, part, whole)
                turns.append((role or "", text or ""))
                size += len(role or "") + len(text or "")
        if turns:
            flush()
        yield rows()

    return run


def format_conversations(conversations: DataFrame, tokenizer: str, piece_chars: int = 1_000_000, piece_turns: int = 512) -> DataFrame:
    """Rows (conv_id, turn, role, text) to FORMATTED rows, of which (part, piece) give the order. tokenizer: the file
    of a byte-level vocabulary."""
    stretch = F.coalesce(F.floor(F.col("turn") / piece_turns).cast("long"), F.lit(-(1 << 62)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", stretch.alias("part"))
    ends = rows.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    several = keep(ends.select(F.col("conv_id").alias("__several"), F.lit(True).alias("__long")), "long-chats")
    flagged = rows.join(several, F.col("conv_id").eqNullSafe(F.col("__several")), "left").withColumn("whole", F.col("__long").isNull())
    flagged = flagged.withColumn("part", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("part")))
    dealt = flagged.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    named = dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "part", "whole", "role", "text")  # a long with nulls is a float in pandas
    return named.mapInPandas(_formatter(tokenizer, piece_chars), FORMATTED)


class _Digest:
    """What is read back of a conversation, turn by turn."""

    def __init__(self):
        self.turns = self.chars = self.formatted = self.tokens = self.learned = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: int, turns_text: bytes, loss_text: bytes, chars: int, formatted: int, tokens: int, learned: int) -> None:
        self.whole.update(turns_text)
        self.loss.update(loss_text)
        self.turns, self.chars, self.formatted, self.tokens, self.learned = self.turns + turns, self.chars + chars, self.formatted + formatted, self.tokens + tokens, self.learned + learned

    def row(self, conv) -> tuple:
        return (conv, self.turns, self.whole.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted, self.tokens, self.learned)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finished rows of the conversations in one stretch; of others, each piece's texts and counts."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    conv, state, out = None, None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            turns = [(unescape(a), unescape(b)) for a, b in _TURNS.findall(r.rendered)]
            turns_text = "".join(f"{a}\n{b}\n" for a, b in turns).encode("utf-8", "surrogatepass")
            said = "".join(masked_texts(r.rendered, np.asarray(r.starts), np.asarray(r.ends), np.asarray(r.loss, dtype=bool)))
            loss_text = said.encode("utf-8", "surrogatepass")
            counts = (len(said), len(r.rendered), len(r.loss), int(np.sum(r.loss)))
            if state is not None and (r.piece == 0 or not r.whole):
                out.append((*state.row(conv), None, None, None, None))
                state = None
            if r.whole:
                conv, state = r.conv_id, state or _Digest()
                state.add(len(turns), turns_text, loss_text, *counts)
            else:
                out.append((r.conv_id, len(turns), None, counts[0], None, *counts[1:], r.part, r.piece, turns_text, loss_text))
        yield pd.DataFrame(out, columns=names).astype({"part": "Int64", "piece": "Int32"})
        out = []
    if state is not None:
        yield pd.DataFrame([(*state.row(conv), None, None, None, None)], columns=names)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces of a conversation, in order, to one row; finished rows as they are."""
    names = [x.split()[0] for x in READ.split(", ")]
    conv, state, out = None, None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if state is not None and (r.turns_text is None or r.conv_id != conv):
                out.append(state.row(conv))
                state = None
            if r.turns_text is None:
                out.append(r[: len(names)])
            else:
                conv, state = r.conv_id, state or _Digest()
                state.add(r.n_turns, r.turns_text, r.loss_text, r.loss_chars, r.formatted_chars, r.n_tokens, r.n_loss_tokens)
        yield pd.DataFrame(out, columns=names)
        out = []
    if state is not None:
        yield pd.DataFrame([state.row(conv)], columns=names)


def masked_texts(rendered: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The texts under the mask, unescaped. Spans of masked tokens that touch or overlap (tokens of parts of one
    character) are one run."""
    s, e = starts[loss], np.maximum.accumulate(ends[loss])
    if not len(s):
        return
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    for at, to in zip(s[first].tolist(), e[last].tolist()):
        yield unescape(rendered[at:to])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its FORMATTED rows say, from renderings, offsets and masks alone. The pieces of a stretch
    must lie in one partition, in order, as format_conversations leaves them."""
    parts = formatted.mapInPandas(_read, PARTS).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return parts.mapInPandas(_chain, READ).withColumn("conv_id", F.col("conv_id").cast("long"))
