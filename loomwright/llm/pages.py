"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A page is read once into its leaf blocks in page order: the text between two block elements, inline elements counted in. A block's features are
what its ancestors are (elements, words of their classes, ids and roles, and how sectioning elements lie in each other) and what its text is
like (length, share of links, signs). The field scores each block by these features, and each pair of neighbours by their labels, apart for
neighbours with the same parent; Viterbi's algorithm gives the best labels of the whole page. Blocks labelled as main text are joined.

The field is trained on the driver by the gradient of the exact likelihood, on ``TRAINING_PAGES`` labelled pages of ``layouts``, a documented number
that does not depend on the input. The tables hold no labelled pages.

Scripts, styles, comments in the markup and other text that is never shown are no blocks. Defined cases: null and empty html give an empty
text, a page without main blocks too; markup may be unclosed or broken; character references are decoded as browsers do; all Unicode white space
inside a block counts; repeated rows are extracted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import text_blocks
from loomwright.llm.layouts import MAIN, labelled_pages

TRAINING_PAGES = 1000
SEED = 11
ROUNDS = 150
LEAST_SEEN = 3

# Elements by what they do to the text. Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
UNSEEN = frozenset("script style template title textarea iframe noembed noframes svg math object audio video canvas head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article aside footer form header main nav section body figure table blockquote".split())
# Which open elements a new one ends, unless one of the second kind lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# What an open paragraph is not ended through, and how far in an end tag is looked for.
P_FENCES = frozenset("td th li div article section button table ul ol blockquote form".split())
DEEPEST = 200

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """A leaf block: its text, the block element that holds it, the number of the one around that, the features of all its ancestors and of the
    nearest one that has a name or is a section, and how many characters lie in links."""

    text: str
    tag: str
    parent: int
    context: frozenset[str]
    near: frozenset[str]
    linked: int


@dataclass
class _Open:
    """An open element, with the block element that it is or lies in, and the number of the one around that."""

    tag: str
    context: frozenset[str]
    near: frozenset[str]
    section: str
    block: str
    nth: int
    parent: int


def own_features(tag: str, attributes: str, section: str) -> tuple[frozenset[str], frozenset[str], str]:
    """What an element adds to the context of its blocks, what it is called (nothing if it has no name and is no section), and the section that
    its blocks lie in."""
    found, near = {f"in:{tag}"}, set()
    if tag in SECTIONS:
        section, outer = tag, section
        found.add(f"in:{outer}/{tag}")
        near.add(f"near:{tag}")
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name != "style":
            words = [w.lower() for w in NAME.findall(value)]
            found.update(f"name:{w}" for w in words)
            near.update(f"near:{w}" for w in words)
    return frozenset(found), frozenset(near), section


def leaf_blocks(page: str, contexts: dict | None = None) -> list[Block]:
    """The leaf blocks of a page in page order. ``contexts`` remembers what elements add, for pages alike."""
    contexts = {} if contexts is None else contexts
    stack = [_Open("", frozenset(), frozenset(), "", "", 0, 0)]
    blocks: list[Block] = []
    parts: list[str] = []
    holder: _Open | None = None
    opened = links = linked = at = 0

    def end_block() -> None:
        nonlocal holder, linked
        if holder is not None:
            text = " ".join("".join(parts).split())
            blocks.append(Block(text, holder.block, holder.parent, holder.context, holder.near, min(linked, len(text))))
        parts.clear()
        holder, linked = None, 0

    def add(raw: str) -> None:
        nonlocal holder, linked
        text = markup.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if holder is None and not text.isspace() and text:
            holder = stack[-1]
        if links:
            linked += len(text)

    def close(depth: int) -> None:
        nonlocal links
        links -= sum(gone.tag == "a" for gone in stack[depth:])
        del stack[depth:]

    def innermost(tags: frozenset[str] | set[str], fences: frozenset[str] | set[str] = frozenset()) -> int:
        """The depth of the innermost open element of ``tags``; 0 if there is none, or one of ``fences`` lies further in."""
        for depth in range(len(stack) - 1, max(0, len(stack) - DEEPEST), -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in fences:
                return 0
        return 0

    while True:
        found = TAG.search(page, at)
        start = found.start() if found else len(page)
        if start > at:
            add(page[at:start])
        if found is None:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        attributes = found[3] or found[6] or ""
        if (found[1] or found[4]) == "/":
            if tag in BLOCKS:
                end_block()
            if depth := innermost({tag}):
                close(depth)
            continue
        if tag in UNSEEN and not attributes.endswith("/"):
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            if over or tag != "head":
                at = over.end() if over else len(page)
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            end_block()
            if depth := innermost({"p"}, P_FENCES):
                close(depth)
        if tag in ENDS and (depth := innermost(*ENDS[tag])):
            close(depth)
        if tag in VOID:
            continue
        above = stack[-1]
        key = tag, attributes, above.section
        if key not in contexts:
            if len(contexts) > 20_000:
                contexts.clear()
            contexts[key] = own_features(*key)
        own, near, section = contexts[key]
        near = near or above.near
        context = above.context if own <= above.context else above.context | own
        opened += 1
        if tag in BLOCKS:
            stack.append(_Open(tag, context, near, section, tag, opened, above.nth))
        else:
            stack.append(_Open(tag, context, near, section, above.block, above.nth, above.parent))
        links += tag == "a"
    end_block()
    return blocks


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    found = [
        "bias",
        f"tag:{block.tag}",
        f"words:{min(words, 256).bit_length()}",
        f"linked:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
        "ends:" + (text[-1] if text[-1] in ".!?:" else "other"),
    ]
    if "©" in text or "copyright" in text[:200].lower():
        found.append("sign:copyright")
    if words < 30 and any(c in text for c in "·|»›"):
        found.append("sign:separators")
    if words <= 12:
        found += [f"short:{w}" for w in set(re.findall(r"\w+", text.lower()))]
    return found


@dataclass
class Field:
    """A linear-chain conditional random field with the labels 0 (other) and 1 (main text)."""

    weights: dict[str, float]
    # Of (label before, label here): [0] for neighbours of different parents, [1] for those of one parent; and of the first label.
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    _contexts: dict[tuple, float] = field(default_factory=dict)

    def scores(self, blocks: list[Block]) -> list[float]:
        """How much more each block looks like main text than not, seen alone."""
        weights, out = self.weights, []
        for b in blocks:
            score = self._contexts.get((b.context, b.near))
            if score is None:
                if len(self._contexts) > 20_000:
                    self._contexts.clear()
                score = self._contexts[b.context, b.near] = sum(weights.get(f, 0.0) for f in b.context | b.near)
            out.append(score + sum(weights.get(f, 0.0) for f in text_features(b)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The labels with the largest sum of scores over the whole page (Viterbi); of equal sums, other goes before main text."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        steps = self.steps.tolist()
        other, main = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for n in range(1, len(blocks)):
            s = steps[blocks[n].parent == blocks[n - 1].parent]
            to_other, to_main = (other + s[0][0], main + s[1][0]), (other + s[0][1], main + s[1][1])
            back.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
            other, main = max(to_other), max(to_main) + scores[n]
        labels = [int(main > other)]
        for choices in reversed(back):
            labels.append(int(choices[labels[-1]]))
        return labels[::-1]


def _likelihood(emit: np.ndarray, same: np.ndarray, mask: np.ndarray, steps: np.ndarray, first: np.ndarray):
    """Of padded pages (pages x blocks): the log of the sum over all labelings, the chance of each label per block, and the chance of each
    pair of neighbouring labels."""
    pages, length = emit.shape
    node = np.stack([np.zeros_like(emit), emit], axis=2)
    edge = steps[same]  # pages x blocks x 2 x 2, that of a block joins it with the one before
    forward = np.zeros((pages, length, 2))
    forward[:, 0] = first + node[:, 0]
    for t in range(1, length):
        into = np.logaddexp(forward[:, t - 1, 0, None] + edge[:, t, 0], forward[:, t - 1, 1, None] + edge[:, t, 1]) + node[:, t]
        forward[:, t] = np.where(mask[:, t, None], into, forward[:, t - 1])
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((pages, length, 2))
    for t in range(length - 2, -1, -1):
        ahead = edge[:, t + 1] + (node[:, t + 1] + backward[:, t + 1])[:, None, :]
        out = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
        backward[:, t] = np.where(mask[:, t + 1, None], out, 0)
    chance = np.exp(forward + backward - whole[:, None, None])
    pair = forward[:, :-1, :, None] + edge[:, 1:] + (node[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    return whole, chance, np.exp(np.where(mask[:, 1:, None, None], pair, -np.inf))


def train(pages: list[str], rounds: int = ROUNDS, strength: float = 1.0, rate: float = 0.15) -> Field:
    """The field of labelled pages, whose main blocks begin with ``MAIN``: gradient ascent on the likelihood with decaying moments."""
    read = [leaf_blocks(p) for p in pages]
    labels = [[b.text.startswith(MAIN) for b in blocks] for blocks in read]
    for blocks in read:
        for b in blocks:
            b.text = b.text.removeprefix(MAIN).strip() or "."
    described = [[text_features(b) + list(b.context | b.near) for b in blocks] for blocks in read]
    seen: dict[str, int] = {}
    for page in described:
        for features in page:
            for f in features:
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    length = max(map(len, read))
    shape = len(read), length
    # Of every feature that a block has: the block and the feature.
    of_block, of_name, flat = [], [], 0
    mask, same, truth = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=int), np.zeros(shape, dtype=int)
    for p, blocks in enumerate(read):
        for t, b in enumerate(blocks):
            known = [names[f] for f in set(described[p][t]) if f in names]
            of_block += [flat] * len(known)
            of_name += known
            flat += 1
            mask[p, t], truth[p, t] = True, labels[p][t]
            same[p, t] = t > 0 and b.parent == blocks[t - 1].parent
    of_block, of_name = np.array(of_block), np.array(of_name)
    together = mask[:, 1:]
    counted = np.zeros((2, 2, 2))
    np.add.at(counted, (same[:, 1:][together], truth[:, :-1][together], truth[:, 1:][together]), 1)
    begun = np.bincount(truth[:, 0], minlength=2)
    parameters = [np.zeros(len(names)), np.zeros((2, 2, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters]
    for k in range(1, rounds + 1):
        weights, steps, first = parameters
        emit = np.zeros(shape)
        emit[mask] = np.bincount(of_block, weights[of_name], flat)
        _, chance, pair = _likelihood(emit, same, mask, steps, first)
        expected = np.stack([pair[same[:, 1:] == s].sum(axis=0) for s in (0, 1)])
        gradient = [
            np.bincount(of_name, (truth[mask] - chance[..., 1][mask])[of_block], len(names)) - strength * weights,
            counted - expected,
            begun - chance[:, 0].sum(axis=0),
        ]
        for i, g in enumerate(gradient):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            parameters[i] = parameters[i] + rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
    weights, steps, first = parameters
    return Field({f: float(weights[i]) for f, i in names.items()}, steps, first)


def main_text(page: str | None, model: Field, contexts: dict | None = None) -> str:
    blocks = leaf_blocks(page or "", contexts)
    return " ".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per page of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``."""
    model = model or train(labelled_pages(TRAINING_PAGES, SEED))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        contexts: dict = {}
        for batch in batches:
            texts = list(batch)
            found = [main_text(t, shared.value, contexts) for block in text_blocks(texts) for t in texts[block]]
            yield pd.Series(found, dtype=object)

    found = pages.select("page_id", "url", run("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
