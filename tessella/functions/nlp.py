"""Analysis of one window of words from a model's score matrices: alignment, roles, chains, entities, facts.

Windows are lists of words; spans are half open unless stated otherwise. What needs a model is
passed in as matrices or callables, so that any provider can be behind it.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field, replace

import numpy as np

from .decode import FORBIDDEN, build_entities, clusters, greedy_spans, log_softmax, sentence_trees, viterbi, vote

LABEL_SUBWORDS, MARKER_SUBWORDS, SPAN_WIDTH = 48, 1024, 12
MARKER = "*"
#: What facts are said to be.
POLARITIES, MODALITIES = ("positive", "negative"), ("asserted", "hypothetical", "planned", "desired", "questioned", "reported")


# Calibration ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Calibration:
    rel_offsets: dict[str, float] = field(default_factory=dict)
    unseen_offset: float = 0.0
    offset: float = 0.0
    rel_top: int = 4
    span_offset: float = 0.0
    coref_link_bias: float = 0.0
    ent_o_bias: float = 0.0
    entity_coref: str = "all"

    @staticmethod
    def load(raw: dict, banked: list[str] = ()) -> "Calibration":
        """Of a decoded file: rel_offset holds for all banked relations, rel_offsets for single ones."""
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        common = raw.get("rel_offset")
        offsets = dict.fromkeys(banked, float(common)) if number(common) else {}
        offsets |= {k: float(v) for k, v in (raw.get("rel_offsets") or {}).items() if number(v)}
        given = {k: float(raw[k]) for k in ("unseen_offset", "offset", "span_offset", "coref_link_bias", "ent_o_bias") if number(raw.get(k))}
        if isinstance(raw.get("rel_top"), int):
            given["rel_top"] = raw["rel_top"]
        return Calibration(offsets, **given, entity_coref=raw["entity_coref"] if isinstance(raw.get("entity_coref"), str) else "all")

    def merged(self, **overrides) -> "Calibration":
        """With the overrides that are set; rel_offsets replaces single entries."""
        single = overrides.pop("rel_offsets", None) or {}
        return replace(self, rel_offsets=self.rel_offsets | single, **{k: v for k, v in overrides.items() if v is not None})

    def relation_offset(self, name: str) -> float:
        return self.rel_offsets.get(name, -self.unseen_offset)


# Words and subwords -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Alignment:
    """ids of the cut encoding; the first subword of each analysed word (-1: none); how many words fit."""

    ids: list[int]
    first: list[int]
    limit: int

    def analysed(self) -> list[bool]:
        return [f >= 0 for f in self.first]

    def ends(self) -> list[int]:
        """Where each word's subwords end: at the next word's first one; one subword where a word has none of its own."""
        n, out, following = len(self.ids), [], len(self.ids) - 1
        for f in reversed(self.first):
            own = 0 <= f < following
            out.append(following if own else min(max(f, 0) + 1, n))
            following = f if own else following
        return out[::-1]


def align(words: list[str], encode, most: int, end_id: int) -> Alignment:
    """Words against encode(text) -> (ids, [(start, end) in bytes]) of the words with blanks between.

    A token belongs to the last word that starts before the token ends; empty ranges are special.
    """
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w.encode()) + 1
    ids, ranges = encode(" ".join(words))
    first = [-1] * len(words)
    for token, (a, b) in enumerate(ranges):
        if a < b and words:
            word = max(bisect_left(starts, b) - 1, 0)
            first[word] = token if first[word] < 0 else first[word]
    ids, limit = list(ids), len(words)
    if len(ids) > most:
        ids = [*ids[:most - 1], end_id]
        limit = next((i for i, f in enumerate(first) if f >= most - 1), limit)
    return Alignment(ids, first[:limit], limit)


def encode_labels(texts: list[str], encode, pad_id: int, most: int = LABEL_SUBWORDS) -> tuple[list[list[int]], list[list[int]]]:
    """(ids, mask) of label texts, cut to most with their last id kept, padded to the longest."""
    rows = [list(encode(t)[0]) for t in texts]
    rows = [r if len(r) <= most else [*r[:most - 1], r[-1]] for r in rows]
    width = max(map(len, rows), default=0)
    return [r + [pad_id] * (width - len(r)) for r in rows], [[1] * len(r) + [0] * (width - len(r)) for r in rows]


def marked_words(tokens: list[str], mentions: list[list[tuple[int, int]]], turns: list[tuple[int, int]], participants: list[str]):
    """(words, where each participant's turns open, where each entity's mentions open): markers around mentions,
    and a participant's name between markers, with a colon, before each turn (word, participant)."""
    opens = {a for m in mentions for a, _ in m}
    closes = {max(b - 1, 0) for m in mentions for _, b in m}
    speaks, words, at = dict(turns), [], {}
    spoken: list[list[int]] = [[] for _ in participants]
    for i, token in enumerate(tokens):
        who = speaks.get(i)
        if who is not None and who < len(participants):
            spoken[who].append(len(words))
            words += [MARKER, participants[who], MARKER, ":"]
        if i in opens:
            at[i] = len(words)
            words.append(MARKER)
        words.append(token)
        if i in closes:
            words.append(MARKER)
    return words, spoken, [[at.get(a, -1) for a, _ in m] for m in mentions]


def marker_input(tokens, mentions, turns, participants, encode, end_id: int, most: int = MARKER_SUBWORDS) -> tuple[list[int], list[list[int]]]:
    """(subword ids, the subword of every opening marker, -1 beyond most): participants first, then entities."""
    words, spoken, places = marked_words(tokens, mentions, turns, participants)
    a = align(words, encode, most, end_id)
    return a.ids, [[a.first[w] if 0 <= w < a.limit else -1 for w in group] for group in (*spoken, *places)]


# Heads ------------------------------------------------------------------------------------------


def bio_runs(tags: list[str]) -> list[tuple[str, int, int]]:
    """(label, start, end): "B-X" opens; "I-" goes on with what is open, whatever its label, or opens."""
    out: list[tuple[str, int, int]] = []
    for i, tag in enumerate(tags):
        if tag[:2] == "I-" and out and out[-1][2] == i:
            out[-1] = (out[-1][0], out[-1][1], i + 1)
        elif tag[:2] in ("B-", "I-"):
            out.append((tag[2:], i, i + 1))
    return out


def labels_above(scores, labels: list[str]) -> tuple[list[str], list[float]]:
    """(labels with a probability above one half, all probabilities) of independent logits."""
    p = 1 / (1 + np.exp(-np.asarray(scores, np.float64)))
    return [name(labels, k) for k in np.flatnonzero(p > 0.5)], p.tolist()


def name(labels: list[str], k: int) -> str:
    return labels[k] if k < len(labels) else f"UNK_{k}"


def best_label(scores, labels: list[str]) -> str:
    return name(labels, int(np.argmax(scores)))


def role_frames(predicate_scores, roles, sentence: list[int], analysed: list[bool], tags: list[str]) -> list[dict]:
    """Frames (predicate, args) of the words whose best predicate class is 1.

    roles(predicate, first, last + 1) scores the words of that stretch, which spans the
    predicate's sentence. Each frame's tags are one constrained path, in which "V" is the
    predicate's tag and no other word's.
    """
    frames, verb, n = [], tags.index("V"), len(sentence)
    for p in (i for i in range(n) if analysed[i] and int(np.argmax(predicate_scores[i])) == 1):
        inside = np.array([analysed[i] and sentence[p] >= 0 and sentence[i] == sentence[p] for i in range(n)])
        own = np.flatnonzero(inside)
        a, b = (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 1)
        scores = np.full((n, len(tags)), FORBIDDEN)
        scores[a:b] = roles(p, a, b)
        scores[~inside] = FORBIDDEN
        lp = log_softmax(scores)
        lp[:, verb] = FORBIDDEN
        lp[p] = FORBIDDEN
        lp[p, verb] = 0.0
        path = [name(tags, k) for k in viterbi_of(lp, tags)]
        frames.append({"predicate": p, "args": [s for s in bio_runs(path) if s[0] != "V"]})
    return frames


def viterbi_of(lp, tags: list[str]) -> list[int]:
    """viterbi() of rows that are log-probabilities already, some of them forbidden."""
    from .decode import bio_constraints

    start, follow = bio_constraints(tags)
    step, best, back = np.where(follow, 0.0, FORBIDDEN), lp[0] + np.where(start, 0.0, FORBIDDEN), []
    for row in lp[1:]:
        through = best[:, None] + step
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def flat_frame(predicate: int, tags: list[str], place: list[int | None]) -> dict | None:
    """One predicate's roles of a token tagger: "B-" opens, "I-" of the same label goes on and of another opens,
    "O", "V", other prefixes and tokens without a place close; a bare tag opens. Ends are included; None without a role."""
    roles, here = [], False
    if predicate >= len(place) or place[predicate] is None:
        return None
    for tag, at in zip(tags, place):
        prefix, _, label = tag.partition("-") if "-" in tag else ("B", "", tag)
        if at is None or tag in ("O", "V") or prefix not in ("B", "I"):
            here = False
        elif prefix == "I" and here and roles[-1][0] == label:
            roles[-1] = (label, roles[-1][1], at)
        else:
            roles.append((label, at, at))
            here = True
    return {"predicate": place[predicate], "roles": roles} if roles else None


def chains(scores, candidates, boundary, bias: float = 0.0) -> list[list[tuple[int, int]]]:
    """Coreference chains as inclusive spans. scores[w] has "no antecedent" (plus bias) first, then candidates[w].

    boundary(heads) gives (positions, start scores, end scores) of each head word: the start is
    the best place at or before the head, the end the best at or after it.
    """
    s = np.array(scores, np.float64)
    s[:, 0] += bias
    best, links = s.argmax(axis=1), []
    for w, k in enumerate(best.tolist()):
        if k and k - 1 < len(candidates[w]) and candidates[w][k - 1] >= 0:
            links.append((w, int(candidates[w][k - 1])))
    groups = clusters(links)
    heads = [h for g in groups for h in g]
    if not heads:
        return []
    spans = {}
    for h, at, left, right in zip(heads, *boundary(heads)):
        at = np.asarray(at)
        start = at[np.where(at > h, FORBIDDEN, left).argmax()]
        end = at[np.where(at < h, FORBIDDEN, right).argmax()]
        spans[h] = (max(int(start), 0), max(int(end), 0))
    return [[spans[h] for h in g] for g in groups]


def tagged_spans(scores, sentences: list[tuple[int, int]], tags: list[str], bias: float = 0.0) -> list[tuple[str, int, int]]:
    """Typed spans of the default head: one constrained path a sentence; bias goes to the first tag's column."""
    lp, out = log_softmax(scores), []
    lp[:, 0] += bias
    for a, b in sentences:
        path = viterbi_of(lp[a:min(b, len(lp))], tags) if a < len(lp) else []
        out += [(label, a + s, a + e) for label, s, e in bio_runs([name(tags, k) for k in path])]
    return out


def schema_spans(logits, candidates: list[tuple[int, int]], sentences: list[tuple[int, int]], offset: float) -> list[tuple[int, int, int]]:
    """(start, end, type) of the schema head that lie within a sentence."""
    return [s for s in greedy_spans(logits, candidates, offset) if any(a <= s[0] and s[1] <= b for a, b in sentences)]


def group_entities(tokens, sentences, typed: list[tuple[str, int, int]], links, coref: str, types: dict[tuple[int, int], str] | None = None) -> list[dict]:
    """Entities (type, mentions): build_entities(), typed by the schema's types of their spans where they have any."""
    out = []
    for mentions in build_entities(tokens, sentences, typed, links, coref):
        named = [types[m["start"], m["end"]] for m in mentions if types and (m["start"], m["end"]) in types]
        out.append({"type": vote(named) if named else mentions[0]["type"], "mentions": mentions})
    return out


def entity_nodes(tokens, entities: list[dict], turns: list[tuple[int, int]], participants: list[str], analysed: list[bool]) -> list[dict]:
    """Nodes of a window: participants that speak, then entities with an analysed mention; mentions by place, each once."""
    nodes = []
    for p, who in enumerate(participants):
        spans = [(a, a + 1) for a, q in turns if q == p and a < len(analysed) and analysed[a]]
        if spans:
            nodes.append({"type": "speaker", "text": who, "speaker": True, "spans": spans})
    for e in entities:
        spans = sorted({(m["start"], m["end"]) for m in e["mentions"] if m["end"] <= len(analysed) and analysed[m["start"]]})
        if spans:
            nodes.append({"type": e["type"], "text": " ".join(tokens[slice(*spans[0])]), "speaker": False, "spans": spans})
    return nodes


def facts(logits, n_entities: int, relations: list[str], calibration: Calibration, top: int | None = None) -> list[dict]:
    """Facts (pair, head, tail, relation, margin) of ordered pairs: the top margins over "none" that are positive."""
    pairs = [(h, t) for h in range(n_entities) for t in range(n_entities) if h != t]
    offsets, out = np.array([calibration.relation_offset(r) for r in relations]), []
    for i, ((h, t), row) in enumerate(zip(pairs, np.asarray(logits, np.float64))):
        margins = row[1:len(relations) + 1] - (row[0] + calibration.offset) + offsets
        for k in np.argsort(-margins, kind="stable")[:calibration.rel_top if top is None else top]:
            if margins[k] > 0:
                out.append({"pair": i, "head": h, "tail": t, "relation": relations[k], "margin": float(margins[k])})
    return out


def attributes(polarity, modality, holder, time) -> dict:
    """What is said of one fact: holder and time are entities, or None where "none" (column 0) is best."""
    at = lambda row: int(np.argmax(row))
    one = lambda names, k: names[k] if k < len(names) else names[0]
    other = lambda k: k - 1 if k else None
    return {"polarity": one(POLARITIES, at(polarity)), "modality": one(MODALITIES, at(modality)), "holder": other(at(holder)), "time": other(at(time))}


def heads_of(arcs, sentence: list[int], analysed: list[bool]) -> list[int]:
    """1-based head of every word in its window, 0 for a root."""
    return sentence_trees(arcs, sentence, analysed)


# One view over windows --------------------------------------------------------------------------


def flatten(windows: list[dict], results: list[dict]) -> dict:
    """Windows (words of (text, start, end); sentences of (start, end)) and their results as one list of tokens.

    Token ranges include their ends; heads are places in that list, None for a root; bytes are
    those of the input. A sentence's act is its first label ("NONE" without one) at the top probability.
    """
    out = {"tokens": [], "sentences": [], "acts": [], "frames": [], "entities": []}
    base = 0
    for w, r in zip(windows, results):
        words, tags = w["words"], {}
        for label, a, b in r.get("ner", ()):
            tags |= {i: f"{'I' if i > a else 'B'}-{label}" for i in range(a, min(b, len(words)))}
            out["entities"].append({"label": label, "first": base + a, "last": base + b - 1, "start": words[a][1], "end": words[b - 1][2], "text": " ".join(t for t, _, _ in words[a:b])})
        heads = r.get("heads") or [None] * len(words)
        for i, (text, start, end) in enumerate(words):
            head = base + heads[i] - 1 if i < len(heads) and heads[i] else None
            out["tokens"].append({"text": text, "start": start, "end": end, "ner": tags.get(i), "head": head, "word": base + i})
        for k, (a, b) in enumerate(w["sentences"]):
            if a == b:
                continue
            out["sentences"].append({"first": base + a, "last": base + b - 1, "start": words[a][1], "end": words[b - 1][2]})
            if r.get("acts") and r["acts"][k][1]:
                labels, scores = r["acts"][k]
                out["acts"].append({"sentence": len(out["sentences"]) - 1, "label": labels[0] if labels else "NONE", "confidence": max(scores), "scores": scores})
        out["frames"] += [{"predicate": base + f["predicate"], "roles": [(label, base + a, base + b - 1) for label, a, b in f["args"]]} for f in r.get("frames", ())]
        base += len(words)
    return out
