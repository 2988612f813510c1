"""Replaceable models and services, with deterministic offline defaults.

Scale note: a provider is made once per Python worker (an iterator pandas UDF or mapInArrow) and sees
Arrow batches.  The default embedder is feature hashing: reproducible, in SQL too, and not semantic.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import json
import logging
import re
from collections.abc import Iterable
from typing import Protocol

import numpy as np
import regex

log = logging.getLogger(__name__)
TOKEN = r"[\p{L}\p{N}_]{2,}"
_TOKEN = regex.compile(TOKEN)
#: The same in lower-case ASCII texts.
_ASCII = re.compile(r"[a-z0-9_]{2,}")


class Embedder(Protocol):
    dim: int

    def encode(self, texts: Iterable[str]) -> np.ndarray:
        """A unit vector (or a zero vector) for each text."""


class Reranker(Protocol):
    def score(self, questions: Iterable[str], chunks: Iterable[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: Iterable[str]) -> list[str]:
        """An answer for each prompt; '' where there is none. Never raises."""


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[str, str]:
        """(html, error) of a page."""


class PageParser(Protocol):
    def pages(self, content: bytes) -> list[tuple[str, list[tuple[float, float, str]]]]:
        """Per page of a document its text stream and its blocks (x0, y0, text)."""


class HashingEmbedder:
    """Each token adds 1 or -1 to one of `dim` places, by its MD5; vectors are normalised."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self._memo = dim, _Places(dim)

    def encode(self, texts: Iterable[str]) -> np.ndarray:
        rows = []
        for text in texts:
            low = (text or "").lower()
            found = list(map(self._memo.__getitem__, (_ASCII if low.isascii() else _TOKEN).findall(low)))
            each = np.bincount(found, minlength=2 * self.dim)
            row = (each[: self.dim] - each[self.dim :]).astype(float)
            size = np.sqrt((row * row).sum())
            rows.append(row / size if size else row)
        return np.stack(rows) if rows else np.zeros((0, self.dim))


class _Places(dict):
    """Where a token counts: its place, `dim` further on if it counts as -1. Kept for at most 500,000 tokens."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        digest = hashlib.md5(token.encode()).hexdigest()
        self[token] = place = int(digest[:8], 16) % self.dim + (0 if digest[8] < "8" else self.dim)
        return place


class OverlapReranker:
    """Scores a pair by the number of distinct words that question and chunk share: a stand-in for a model that SQL can follow."""

    def score(self, questions: Iterable[str], chunks: Iterable[str]) -> np.ndarray:
        return np.array([float(len({*q.split()} & {*c.split()})) for q, c in zip(questions, chunks, strict=True)])


class FunctionGenerator:
    """A generator around a function of one prompt; whatever it raises counts as no answer."""

    def __init__(self, function) -> None:
        self.function = function

    def generate(self, prompts: Iterable[str]) -> list[str]:
        out = []
        for prompt in prompts:
            try:
                out.append(self.function(prompt) or "")
            except Exception:  # noqa: BLE001 - a failed call falls back to the extractive answer
                out.append("")
        return out


class ModelEmbedder:
    """Unit vectors of a sentence-transformers model, where that library is installed."""

    def __init__(self, name: str = "all-MiniLM-L6-v2") -> None:
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name)
        self.dim = self.model.get_sentence_embedding_dimension()

    def encode(self, texts: Iterable[str]) -> np.ndarray:
        return np.asarray(self.model.encode(list(texts), normalize_embeddings=True), dtype=np.float64)


class CrossEncoderReranker:
    """Pair scores of a sentence-transformers cross-encoder, where that library is installed; equal scores, which keep the order, where it fails."""

    def __init__(self, name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2") -> None:
        self.model = None
        try:
            from sentence_transformers.cross_encoder import CrossEncoder

            self.model = CrossEncoder(name)
        except Exception as e:  # noqa: BLE001 - no library, no model file: retrieval's order stays
            log.warning("no cross-encoder: %s", e)

    def score(self, questions: Iterable[str], chunks: Iterable[str]) -> np.ndarray:
        pairs = list(zip(questions, chunks, strict=True))
        try:
            return np.asarray(self.model.predict(pairs), dtype=np.float64) if self.model is not None else np.zeros(len(pairs))
        except Exception as e:  # noqa: BLE001
            log.warning("reranking failed: %s", e)
            return np.zeros(len(pairs))


class _Posting:
    """A generator that posts each prompt as JSON; whatever goes wrong, or is no text, counts as no answer.

    Requests carry a key made from the prompt, by which an endpoint can tell a repeated call.
    """

    url: str
    timeout: float

    def headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"}

    def body(self, prompt: str) -> dict:
        raise NotImplementedError

    def answer(self, data) -> str:
        raise NotImplementedError

    def generate(self, prompts: Iterable[str]) -> list[str]:
        from urllib.request import Request, urlopen

        out = []
        for prompt in prompts:
            try:
                headers = self.headers() | {"Idempotency-Key": hashlib.sha256(prompt.encode()).hexdigest()}
                with urlopen(Request(self.url, json.dumps(self.body(prompt)).encode(), headers), timeout=self.timeout) as reply:  # noqa: S310
                    out.append((self.answer(json.load(reply)) or "").strip())
            except Exception as e:  # noqa: BLE001 - a status like 503 (the model loads), a timeout, a broken reply
                log.warning("no generated answer: %s", e)
                out.append("")
        return out


class HostedGenerator(_Posting):
    """A hosted text-generation endpoint. 300 new tokens, temperature 0.2, 45 seconds."""

    def __init__(self, url: str, token: str = "", max_new_tokens: int = 300, temperature: float = 0.2, timeout: float = 45) -> None:
        self.url, self.token, self.max_new_tokens, self.temperature, self.timeout = url, token, max_new_tokens, temperature, timeout

    def headers(self) -> dict[str, str]:
        return super().headers() | ({"Authorization": f"Bearer {self.token}"} if self.token else {})

    def body(self, prompt: str) -> dict:
        return {"inputs": prompt, "parameters": {"max_new_tokens": self.max_new_tokens, "temperature": self.temperature, "do_sample": False, "return_full_text": False}}

    def answer(self, data) -> str:
        return data[0].get("generated_text", "") if isinstance(data, list) and data else ""


class LocalGenerator(_Posting):
    """A local generation server. The model's name, its port, 60 seconds."""

    def __init__(self, url: str = "http://localhost:11434/api/generate", model: str = "llama3.1:8b", timeout: float = 60) -> None:
        self.url, self.model, self.timeout = url, model, timeout

    def body(self, prompt: str) -> dict:
        return {"model": self.model, "prompt": prompt, "stream": False}

    def answer(self, data) -> str:
        return data.get("response", "") if isinstance(data, dict) else ""


class MuPdfPages:
    """Pages of PDF files by PyMuPDF, where it is installed; images are read by Tesseract, where that is."""

    @staticmethod
    def available() -> bool:
        return importlib.util.find_spec("pymupdf") is not None or importlib.util.find_spec("fitz") is not None

    def __init__(self) -> None:
        self.library = importlib.import_module("pymupdf" if importlib.util.find_spec("pymupdf") else "fitz")

    def pages(self, content: bytes) -> list[tuple[str, list[tuple[float, float, str]]]]:
        with self.library.open(stream=content, filetype="pdf") as document:
            return [(page.get_text("text") or "", [(b[0], b[1], b[4] or "") for b in page.get_text("blocks") or []]) for page in document]

    def ocr(self, content: bytes, number: int) -> str:
        try:
            import io

            import pytesseract
            from PIL import Image

            with self.library.open(stream=content, filetype="pdf") as document:
                return pytesseract.image_to_string(Image.open(io.BytesIO(document[number - 1].get_pixmap(dpi=200).tobytes("png")))) or ""
        except Exception as e:  # noqa: BLE001 - no library or no text: the page stays empty
            log.warning("a page wasn't read: %s", e)
            return ""
