"""Chat formatting on a prefix tree: conversations that start alike share the tokens of what they share.

A turn is written as <|role|>text<|end|> with the text escaped, so no text can hold a control string. A block is
a part of the tree written depth first: each node's tokens once, position ids that go on from the node's parent,
and the intervals of its ancestors' tokens, which with its own are all that its tokens attend to. Ancestors that stand
side by side are one interval, so a conversation that forks nowhere needs one.

Here a token is a code point and a node's position ids are a range, given by its first: blocks are made once and any
vocabulary can encode them later, as control strings and nodes' bounds are places where every tokenizer may be cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut, ship_package

# A block's nodes, one entry each: their bounds, first position and loss, the path that ends there (or null) and how many
# of the intervals (all nodes' in a row, starts and stops) are their ancestors'.
NODES = ["starts", "stops", "positions", "loss_starts", "loss_stops", "leaves", "n_intervals", "interval_starts", "interval_stops"]
BLOCK = "trunk long, cell long, tokens string, " + ", ".join(f"{n} array<{'string' if n == 'leaves' else 'long'}>" for n in NODES)
END = "<|end|>"
_SEEN = re.compile(r"[\\<\[]")
_HIDDEN = re.compile(r"\\\\|<\\|\[\\")
_TURN = re.compile(r"<\|((?:[^<|]|<[\\!])*)\|>((?:[^<]|<\\)*)<\|end\|>", re.S)


def escape(text: str) -> str:
    r"""No <|, </ or [ of a control string is left: \ becomes \\, < becomes <\ and [ becomes [\."""
    return _SEEN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[0][0], text)


@lru_cache(maxsize=1024)
def role_mark(role: str) -> str:
    return f"<|{escape(role).replace('|', '<!')}|>"


def turn_text(role: str, text: str) -> str:
    return role_mark(role) + escape(text) + END


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1].replace("<!", "|")), unescape(m[2])) for m in _TURN.finditer(formatted)]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, roles, texts): a conversation's turns by turn, role and text. Null roles and texts are empty.

    A row without a conv_id is a conversation of its own, so that such rows never meet in one task."""
    each = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("t"))
    alone = turns.where("conv_id IS NULL").select("conv_id", F.array(each).alias("t"))
    return grouped.unionByName(alone).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))


def prefix_hashes(turns: list[tuple[str, str]]) -> list[int]:
    """A 64-bit hash (signed) of each prefix of a conversation, shortest first."""
    h, out = xxhash.xxh3_64(), []
    for role, text in turns:
        for part in (role, text):
            raw = part.encode()
            h.update(len(raw).to_bytes(8, "little") + raw)
        out.append(h.intdigest() - (1 << 63))
    return out


def _paths(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in it:
        pairs = [list(zip(r, t)) for r, t in zip(pdf["roles"], pdf["texts"])]
        whole = [hashlib.sha256("".join([f"{len(x)}:{x}" for p in c for x in p]).encode()).hexdigest() for c in pairs]
        yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "path": whole, "prefixes": [prefix_hashes(c) for c in pairs], "roles": pdf["roles"], "texts": pdf["texts"]})


def tree_blocks(paths: DataFrame, block_paths: int) -> DataFrame:
    """paths (path, prefixes, roles, texts: distinct conversations) with trunk and cell, which name each path's block.

    A block holds about block_paths paths: below the deepest prefix that more than so many share, its trunk, paths go to
    cells by the turn after it, and paths below no such prefix by their first turn. So whatever begins alike stands
    together, and only trunks are written more than once."""
    each = cut(paths.select("path", F.posexplode("prefixes").alias("depth", "prefix")))
    hot = cut(each.groupBy("prefix").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block_paths))
    trunk = each.join(hot, "prefix").groupBy("path").agg(F.max(F.struct("depth", "prefix", "held")).alias("t"))
    found = paths.join(trunk, "path", "left")
    below = F.get("prefixes", F.coalesce(F.col("t.depth") + 1, F.lit(0)))
    cells = F.ceil(F.coalesce("t.held", F.lit(paths.count())) / block_paths)
    return found.select("path", "roles", "texts", F.coalesce("t.prefix", F.lit(0)).alias("trunk"), F.pmod(F.xxhash64(F.coalesce(below, F.lit(0))), cells).alias("cell"))


def render_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: one block's tokens, depth first, and its nodes."""
    root: dict = {}  # (role, text) to [kids, path that ends here]
    for path, roles, texts in sorted(zip(pdf["path"], pdf["roles"], pdf["texts"]), key=lambda x: x[0]):
        kids = root
        for turn in zip(roles, texts):
            if (node := kids.get(turn)) is None:
                node = kids[turn] = [{}, None]
            kids = node[0]
        node[1] = path
    text, size, of = [], 0, {n: [] for n in NODES}
    starts, stops, positions, loss_starts, loss_stops, leaves, n_intervals, interval_starts, interval_stops = of.values()
    todo = [(turn, node, 0, ()) for turn, node in reversed(root.items())]
    while todo:
        (role, said), (kids, leaf), position, above = todo.pop()
        mark = role_mark(role)
        own = mark + escape(said) + END
        end = size + len(own)
        speaks = role == "assistant"
        starts.append(size)
        stops.append(end)
        positions.append(position)
        loss_starts.append(size + len(mark) if speaks else size)
        loss_stops.append(end - len(END) if speaks else size)
        leaves.append(leaf)
        n_intervals.append(len(above))
        interval_starts += [a for a, _ in above]
        interval_stops += [b for _, b in above]
        text.append(own)
        below = (*above[:-1], (above[-1][0], end)) if above and above[-1][1] == size else (*above, (size, end))
        size = end
        todo += [(turn, node, position + len(own), below) for turn, node in reversed(kids.items())]
    return pd.DataFrame({"trunk": pdf["trunk"].iloc[:1], "cell": pdf["cell"].iloc[:1], "tokens": ["".join(text)], **{n: [v] for n, v in of.items()}})


def read_block(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """For mapInPandas: what each path of a block says, from its tokens, intervals and loss mask alone."""
    for pdf in it:
        out = []
        for tokens, *nodes in zip(pdf["tokens"], *[pdf[n] for n in NODES]):
            starts, stops, positions, loss_starts, loss_stops, leaves, n_intervals, interval_starts, interval_stops = [x.tolist() for x in nodes]
            first, at = dict(zip(starts, range(len(starts)))), 0
            for k, leaf in enumerate(leaves):
                spans = list(zip(interval_starts[at : at + n_intervals[k]], interval_stops[at : at + n_intervals[k]])) + [(starts[k], stops[k])]
                at += n_intervals[k]
                if leaf is None:
                    continue
                formatted = "".join([tokens[a:b] for a, b in spans])
                if len(formatted) != positions[k] + stops[k] - starts[k]:
                    raise ValueError("positions don't follow from the ancestors")
                loss = []
                for a, b in spans:  # an interval's nodes follow each other
                    i = first[a]
                    while i < len(starts) and starts[i] < b:
                        loss.append(tokens[loss_starts[i] : loss_stops[i]])
                        i += 1
                turns, told = parse(formatted), unescape("".join(loss))
                said = "".join([f"{role}\n{text}\n" for role, text in turns])
                out.append((leaf, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest(), len(formatted)))
        yield pd.DataFrame(out, columns=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_blocks(turns: DataFrame, block_paths: int = 512) -> tuple[DataFrame, DataFrame]:
    """(members, blocks) of conversations given as rows (conv_id, turn, role, text).

    members: conv_id and the path it says. blocks: BLOCK's columns. Equal conversations are one path, combined before
    the shuffle. Each row with a null conv_id is a conversation; equal rows all count, equal turn numbers go by role and
    text. A conversation, however long its turns, is read by one task. Other columns aren't read."""
    ship_package(turns.sparkSession)
    said = conversations(turns.select("conv_id", "turn", "role", "text")).mapInPandas(_paths, "conv_id long, path string, prefixes array<long>, roles array<string>, texts array<string>")
    said = cut(said)
    paths = cut(said.groupBy("path").agg(*[F.first(c).alias(c) for c in ("prefixes", "roles", "texts")]))
    blocks = tree_blocks(paths, block_paths).groupBy("trunk", "cell").applyInPandas(render_block, BLOCK)
    return said.select("conv_id", "path"), blocks


def formatted(turns: DataFrame, block_paths: int = 512) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the written blocks."""
    from folioscope.llm.common import written

    members, blocks = format_blocks(turns, block_paths)
    read = written(blocks, "chat-blocks").mapInPandas(read_block, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(cut(read), "path").drop("path")
