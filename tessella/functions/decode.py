"""Structured decoding of score matrices: sequential algorithms in numpy, one window a row."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from .text import FUNCTION_WORDS

FORBIDDEN = -1e9


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    top = x.max(axis=-1, keepdims=True)
    ok = np.isfinite(top)
    s = x - np.where(ok, top, 0)
    return np.where(ok, s - np.log(np.exp(np.where(ok, s, 0)).sum(axis=-1, keepdims=True)), 0.0)


def bio_constraints(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(may start, may follow[from, to]): I-X only after B-X or I-X."""
    start = np.array([not x.startswith("I-") for x in labels])
    follow = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a[:2] in ("B-", "I-") for b in labels] for a in labels])
    return start, follow


def viterbi(scores: np.ndarray, labels: list[str], keep: np.ndarray | None = None) -> list[int]:
    """The best path of log-softmaxed scores under the constraints; ties go to the lowest label.

    keep marks the positions that take part; the others get label 0.
    """
    scores = np.asarray(scores, np.float64)
    at = np.arange(len(scores)) if keep is None else np.flatnonzero(keep)
    path = [0] * len(scores)
    if not len(at):
        return path
    start, follow = bio_constraints(labels)
    lp, step = log_softmax(scores[at]), np.where(follow, 0.0, FORBIDDEN)
    best, back = lp[0] + np.where(start, 0.0, FORBIDDEN), []
    for row in lp[1:]:
        through = best[:, None] + step
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    k = int(best.argmax())
    for i in range(len(at) - 1, -1, -1):
        path[at[i]] = k
        k = int(back[i - 1][k]) if i else k
    return path


def arborescence(scores: np.ndarray) -> list[int]:
    """Heads of the maximum spanning arborescence; scores[i, j] is that of head j for node i, 0 is the root.

    Cycles are contracted into one node until none is left, then opened again from the last.
    """
    s = np.array(scores, np.float64)
    np.fill_diagonal(s, -np.inf)
    n = len(s)
    arcs = {(i, j): (i, j) for i in range(1, n) for j in range(n) if i != j}  # what an arc stands for
    weight = {k: s[k] for k in arcs}
    nodes, opened, new = list(range(n)), [], n
    while True:
        head = {i: max((j for j in nodes if (i, j) in weight), key=lambda j: (weight[i, j], -nodes.index(j))) for i in nodes if i}
        cycle = _cycle(head)
        if cycle is None:
            break
        inside = set(cycle)
        rest = [x for x in nodes if x not in inside]
        held = {i: weight[i, head[i]] for i in cycle}
        for x in rest:
            into = max(((weight[i, x] - held[i], -k, i) for k, i in enumerate(cycle) if (i, x) in weight), default=None)
            if into is not None:
                weight[new, x], arcs[new, x] = into[0], arcs[into[2], x]
            out = max(((weight[x, i], -k, i) for k, i in enumerate(cycle) if (x, i) in weight), default=None)
            if out is not None:
                weight[x, new], arcs[x, new] = out[0], arcs[x, out[2]]
        opened.append((new, cycle, {i: arcs[i, head[i]] for i in cycle}))
        nodes, new = [*rest, new], new + 1
    chosen = {i: arcs[i, j] for i, j in head.items()}
    for node, cycle, inner in reversed(opened):
        entry = chosen.pop(node)
        kept = dict(inner)
        # the arc that enters lands on one original node, whose cycle arc goes
        kept.pop(next(i for i in cycle if _holds(i, entry[0], opened)))
        chosen.update(kept)
        chosen[next(i for i in cycle if _holds(i, entry[0], opened))] = entry
    heads = [-1] * n
    for i, j in chosen.values():
        heads[i] = j
    return heads


def _holds(node: int, original: int, opened) -> bool:
    if node == original:
        return True
    return any(node == name and any(_holds(i, original, opened) for i in cycle) for name, cycle, _ in opened)


def _cycle(head: dict[int, int]) -> list[int] | None:
    done: set[int] = set()
    for start in head:
        path, x = [], start
        while x in head and x not in done:
            if x in path:
                return path[path.index(x):]
            path.append(x)
            x = head[x]
        done.update(path)
    return None


def tree(scores: np.ndarray) -> list[int]:
    """An arborescence with one child of the root: the best over candidates where the free one has more."""
    heads = arborescence(scores)
    roots = [i for i in range(1, len(heads)) if heads[i] == 0]
    if len(roots) <= 1:
        return heads
    best = (-np.inf, heads)
    for r in roots:
        s = np.array(scores, np.float64)
        s[1:, 0] = -np.inf
        s[r, 0] = scores[r][0]
        h = arborescence(s)
        total = sum(s[i, h[i]] for i in range(1, len(h)))
        if total > best[0]:
            best = (total, h)
    return best[1]


def sentence_trees(arcs: np.ndarray, sentence: list[int], analysed: list[bool]) -> list[int]:
    """Head column of every word (0 root, else 1 + word): one tree a sentence, raw argmax elsewhere."""
    arcs = np.asarray(arcs, np.float64)
    out, lp = arcs.argmax(axis=1).tolist(), log_softmax(arcs)
    of = defaultdict(list)
    for i, (s, ok) in enumerate(zip(sentence, analysed)):
        if ok and s >= 0:
            of[s].append(i)
    for w in of.values():
        m = np.full((len(w) + 1, len(w) + 1), -np.inf)
        m[1:, 0] = lp[w, 0]
        m[1:, 1:] = lp[np.ix_(w, [i + 1 for i in w])]
        for i, h in zip(w, tree(m)[1:]):
            out[i] = w[h - 1] + 1 if h > 0 else 0
    return out


def clusters(links: list[tuple[int, int]]) -> list[list[int]]:
    """Components of two or more nodes, sorted."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in sorted(parent):
        groups[root(x)].append(x)
    return sorted(g for g in groups.values() if len(g) > 1)


def greedy_spans(logits: np.ndarray, spans: list[tuple[int, int]], offset: float = 0.0) -> list[tuple[int, int, int]]:
    """(start, end, type): spans by falling positive margin over column 0, none over another; in order."""
    logits = np.asarray(logits, np.float64)
    if not len(logits) or not spans or logits.shape[1] < 2:
        return []
    margin = logits[:, 1:] - logits[:, :1] - offset
    kind, best = margin.argmax(axis=1), margin.max(axis=1)
    taken, out = set(), []
    for i in np.argsort(-best, kind="stable"):
        if best[i] <= 0:
            break
        words = range(*spans[i])
        if taken.isdisjoint(words):
            taken.update(words)
            out.append((*spans[i], int(kind[i])))
    return sorted(out)


def multi_label(logits: list[float], labels: list[str], above: float = 0.5) -> list[str]:
    return [x for x, v in zip(labels, logits) if 1 / (1 + np.exp(-v)) > above]


#: Fine entity types and their coarse ones.
COARSE = ("LOC", "MISC", "NUM", "ORG", "PER", "TIME")
COARSE_OF = {
    "PERSON": "PER", "ORG": "ORG", "GPE": "LOC", "LOC": "LOC", "FAC": "LOC", "DATE": "TIME", "TIME": "TIME", "PERCENT": "NUM", "MONEY": "NUM", "QUANTITY": "NUM",
    "ORDINAL": "NUM", "CARDINAL": "NUM", "NORP": "MISC", "PRODUCT": "MISC", "EVENT": "MISC", "WORK_OF_ART": "MISC", "LAW": "MISC", "LANGUAGE": "MISC",
}
COUNTS, BY_NAME = ("CARDINAL", "ORDINAL"), ("PER", "ORG", "LOC", "MISC")


def same_name(a: list[str], b: list[str]) -> bool:
    """The in-row twin of text.names_compatible."""
    x, y = ([t.lower() for t in m if t.lower() not in FUNCTION_WORDS] for m in (a, b))
    if not x or not y:
        return False
    (short, raw), (long, raw_long) = ((x, a), (y, b)) if len(x) <= len(y) else ((y, b), (x, a))
    letters = "".join(raw).replace(".", "")
    caps = [t for t in raw_long if t[:1].isupper() and t.lower() not in FUNCTION_WORDS]
    acronym = len(letters) >= 2 and letters == "".join(t[0] for t in caps) and len(caps) >= 2 and not any(c.islower() for c in letters) and any(c.isupper() for c in letters)
    return set(short) <= set(long) or acronym


def build_entities(tokens: list[str], sentences: list[tuple[int, int]], spans: list[tuple[str, int, int]], chains: list[list[tuple[int, int]]], coref: str = "all") -> list[list[dict]]:
    """Entities of a window as lists of mentions {name, start, end, sentence, type}; none if fewer than two.

    Typed spans (half open) that share a chain (inclusive) and a coarse type are one entity
    (coref "all"), if their names agree ("compatible"), or never ("none"); then equal names of
    naming types merge; mentions over a sentence's end go.
    """
    typed = [(t if t in COARSE else COARSE_OF.get(t, "MISC"), a, b) for t, a, b in spans if t not in COUNTS]
    if len(typed) < 2:
        return []
    groups, free = [], dict.fromkeys(range(len(typed)))
    for chain in chains if coref != "none" else ():
        buckets: dict[str, list[int]] = defaultdict(list)
        for first, last in chain:
            for i in [i for i in free if typed[i][1] <= last and first <= max(typed[i][2] - 1, 0)]:
                buckets[typed[i][0]].append(i)
                del free[i]
        for members in buckets.values():
            groups += _agreeing(tokens, typed, members) if coref == "compatible" else [members]
    groups += [[i] for i in free]
    merged: list[list[int]] = []
    by_name: dict[tuple[str, str], int] = {}
    for g in groups:
        kind, a, b = typed[g[0]]
        key = (kind, " ".join(tokens[a:b]).lower())
        if kind in BY_NAME and len(key[1]) > 2 and key in by_name:
            merged[by_name[key]] += g
            continue
        if kind in BY_NAME:
            by_name[key] = len(merged)
        merged.append(list(g))
    out = []
    for g in merged:
        mentions = []
        for kind, a, b in (typed[i] for i in g):
            at = max((k for k, (s, _) in enumerate(sentences) if s <= a), default=0)
            if b <= sentences[at][1]:
                mentions.append({"name": " ".join(tokens[a:b]), "start": a, "end": b, "sentence": at, "type": kind})
        if mentions:
            out.append(mentions)
    return out if len(out) >= 2 else []


def _agreeing(tokens, typed, members) -> list[list[int]]:
    left, out = list(members), []
    while left:
        group, grown = [left.pop(0)], True
        while grown:
            near = [i for i in left if any(same_name(tokens[typed[i][1]:typed[i][2]], tokens[typed[j][1]:typed[j][2]]) for j in group)]
            left, grown = [i for i in left if i not in near], bool(near)
            group += near
        out.append(sorted(group, key=members.index))
    return out


def vote(types: list[str]) -> str:
    """The most frequent type; of equals the one first seen last."""
    n, seen = Counter(types), {t: -i for i, t in reversed(list(enumerate(types)))}
    return max(n, key=lambda t: (n[t], -seen[t]))


def text_boxes(prob: np.ndarray, threshold: float = 0.3, least_score: float = 0.6, ratio: float = 1.5, least_side: int = 3) -> list[tuple[float, float, float, float, float]]:
    """(x0, y0, x1, y1, score) of 4-connected regions of a probability map, grown back; in scan order."""
    p = np.asarray(prob, np.float64)
    if not p.size:
        return []
    h, w = p.shape
    on = p >= threshold
    label = np.where(on, np.arange(h * w).reshape(h, w), h * w)
    while True:  # the smallest label of the neighbourhood, until nothing moves
        n = np.pad(label, 1, constant_values=h * w)
        new = np.where(on, np.minimum.reduce([label, n[:-2, 1:-1], n[2:, 1:-1], n[1:-1, :-2], n[1:-1, 2:]]), h * w)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[on]):
        y, x = np.nonzero(label == k)
        x0, y0, x1, y1 = float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1)
        score = float(p[y, x].mean())
        if min(x1 - x0, y1 - y0) < least_side or score < least_score:
            continue
        d = (x1 - x0) * (y1 - y0) * ratio / (2 * (x1 - x0 + y1 - y0))
        out.append((max(x0 - d, 0.0), max(y0 - d, 0.0), min(x1 + d, float(w)), min(y1 + d, float(h)), score))
    return out


def reading_order(boxes: list[tuple], threshold: float) -> list[tuple]:
    """Boxes by line, then from the left; a line holds what starts within threshold of its first box."""
    out, line = [], []
    for b in sorted(boxes, key=lambda b: b[1]):
        if line and abs(b[1] - line[0][1]) > threshold:
            out += sorted(line, key=lambda b: b[0])
            line = []
        line.append(b)
    return out + sorted(line, key=lambda b: b[0])
