"""A built-in provider without weights: hashes stand in for models, so that plans can be run and tested.

Its results are synthetic and say nothing about the quality of any model.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

from .base import Provider, register

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def unit(word: str, dim: int) -> np.ndarray:
    raw = hashlib.shake_128(word.encode()).digest(dim)
    v = np.frombuffer(raw, np.uint8).astype(np.float64) - 127.5
    return v / np.linalg.norm(v)


def term_id(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")


class Model:
    def __init__(self, task: str, options: dict):
        self.task, self.dim, self.heads = task, int(options.get("dimensions", 32)), options.get("heads")
        self.run = getattr(self, f"_{task}")

    def _embed(self, batch):
        out = []
        for t in batch:
            v = np.sum([unit(w, self.dim) for w in words(t or "")] or [np.zeros(self.dim)], axis=0)
            n = np.linalg.norm(v)
            out.append((v / n if n > 1e-12 else v).tolist())
        return out

    def _embed_sparse(self, batch):
        return [[{"term": k, "weight": math.log1p(n)} for k, n in sorted(Counter(map(term_id, words(t or ""))).items())] for t in batch]

    def _embed_multi_vector(self, batch):
        return [[unit(w, self.dim).tolist() for w in words(t or "")] for t in batch]

    def _embed_hybrid(self, batch):
        """Only the heads that are asked for, from one pass over the words."""
        heads = self.heads or ("dense", "sparse", "multi_vector")
        parts = {"dense": self._embed, "sparse": self._embed_sparse, "multi_vector": self._embed_multi_vector}
        made = {h: parts[h](batch) for h in heads}
        return [{h: made[h][i] if h in made else None for h in parts} for i in range(len(batch))]

    def _rerank(self, batch):
        """Share of the query's words that a document has, of (query, doc) pairs."""
        return [len(set(words(q)) & set(words(d))) / max(1, len(set(words(q)))) for q, d in batch]

    def _generate(self, batch):
        return [f"echo: {t}" for t in batch]


    def _bytes(self, batch):
        return [unit(hashlib.sha256(bytes(b or b"")).hexdigest(), self.dim).tolist() for b in batch]

    _embed_image = _embed_audio = _bytes

    def _embed_multimodal(self, batch):
        """Blocks' vectors, summed: words of texts, hashes of bytes and links."""
        out = []
        for blocks in batch:
            v = np.zeros(self.dim)
            for b in blocks if blocks is not None else ():
                made = self._embed([b["text"]]) if b["kind"] == "text" else self._bytes([b["image"] if b["image"] is not None else (b["url"] or "").encode()])
                v += np.array(made[0])
            n = np.linalg.norm(v)
            out.append((v / n if n > 1e-12 else v).tolist())
        return out

    def _raw(self, batch):
        """Each tensor's elements, doubled."""
        return [{k: [2.0 * x for x in v] for k, v in tensors.items()} for tensors in batch]

    def _lines(self, image) -> list[str]:
        """What bytes say as text, line by line: a stand-in for reading pixels."""
        return [x for x in bytes(image or b"").decode(errors="replace").split("\n") if x.strip()]

    def _document_extract(self, batch):
        return [[{"reading_order": i, "kind": "text", "content": x} for i, x in enumerate(self._lines(b))] for b in batch]

    def _ocr(self, batch):
        return [{"text": "\n".join(x), "blocks": [{"text": t, "confidence": 1.0} for t in x]} for x in map(self._lines, batch)]

    def _transcribe(self, batch):
        """A segment for each begun second of WAV bytes, that says how loud it is."""
        from ..sources.audio import RATE, read_wav

        out = []
        for b in batch:
            x = read_wav(bytes(b)) if b is not None else np.zeros(0)
            parts = [x[a:a + RATE] for a in range(0, len(x), RATE)]
            out.append([{"start_ms": 1000 * i, "end_ms": 1000 * i + 1000 * len(p) // RATE, "text": "loud" if np.abs(p).mean() > 0.1 else "quiet"} for i, p in enumerate(parts)])
        return out

    def _nlp(self, batch):
        """Windows of prose; a word's head is the one before it in its sentence, capitalised words are entities,
        and a sentence's act goes by its last mark."""
        from ..functions import nlp, segment

        out = []
        for text in batch:
            raw, windows, results, at, size = text or "", [], [], 0, 0
            for w in segment.windows([(None, p) for p in raw.split("\n\n") if p.strip()]):
                placed = []
                for token in w["tokens"]:
                    found = raw.find(token, at)
                    start = size + len(raw[at:found].encode())
                    size = start + len(token.encode())
                    placed.append((token, start, size))
                    at = found + len(token)
                spans = [(s["start"], s["end"]) for s in w["sentences"]]
                heads = [0] * len(placed)
                for a, b in spans:
                    heads[a + 1:b] = range(a + 1, b)
                named = [f"{'I' if i and placed[i - 1][0][:1].isupper() else 'B'}-NAME" if t[:1].isupper() else "O" for i, (t, _, _) in enumerate(placed)]
                acts = [(["question"], [0.9, 0.1]) if placed[b - 1][0] == "?" else ([], [0.1, 0.4]) for _, b in spans]
                windows.append({"words": placed, "sentences": spans})
                results.append({"heads": heads, "ner": nlp.bio_runs(named), "acts": acts})
            flat = nlp.flatten(windows, results)
            out.append({"tokens": flat["tokens"], "sentences": flat["sentences"], "acts": [{k: a[k] for k in ("sentence", "label", "confidence")} for a in flat["acts"]], "entities": flat["entities"]})
        return out


class Deterministic(Provider):
    provider_id = "local/deterministic"
    tasks = (
        "embed", "embed_sparse", "embed_multi_vector", "embed_hybrid", "rerank", "generate", "raw", "embed_image", "embed_audio", "embed_multimodal", "document_extract", "transcribe", "ocr", "nlp",
    )

    def load(self, task: str, model_id: str, options: dict):
        return Model(task, options)

    def dimensions(self, model_id: str, options: dict) -> int | None:
        return int(options.get("dimensions", 32))


register(Deterministic())
