"""A language model behind an HTTP service: answers, streamed answers, rewrites, standalone questions, verdicts.

Two public wire formats are spoken: chat completions (``.../chat/completions``) and messages
(``.../messages``); the address tells which. Instances hold plain values only, so that they can be sent
to the workers; every method is an ordinary callable, and whatever it raises makes its caller fall back
to the offline way and say why (``failure``).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from http.client import HTTPException
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

ANSWER = """Answer the question from the numbered sources alone, in as few sentences as it takes, in the language of the question.
Put the number of the source that says so in square brackets after each sentence, as in [2].
If the sources do not answer the question, say so and give no number."""
REWRITE = """Write up to three short search queries that find passages of technical documentation which answer the user's question.
One query a line, nothing else. Give each part of a compound question a query of its own, in the words such documentation would use."""
CONDENSE = """The user's earlier questions are followed by a new one that may lean on them.
Rewrite the new question so that it can be understood alone; keep its meaning and language. Reply with that one line only."""
JUDGE = """You check an answer against a reference fact and against the sources it cites.
Reply with one JSON object: {"correct": true or false, "grounded": true or false, "reason": "a short reason"}.
correct: the answer states the reference fact. grounded: each of its sentences is supported by the sources cited for it."""


def failure(e: Exception) -> str:
    """What went wrong with a backend, for a warning."""
    if isinstance(e, HTTPError):
        told = {401: "the service rejected the key", 403: "the service rejected the key", 429: "the service's rate limit was hit"}
        return told.get(e.code, f"the service answered with error {e.code}")
    if isinstance(e, (URLError, TimeoutError, ConnectionError, HTTPException)):
        return "the service could not be reached"
    if isinstance(e, BackendError):
        return str(e)
    return f"the backend failed ({type(e).__name__})"


class BackendError(RuntimeError):
    """A reply that can't be used: a refusal, or no text."""


def sources_text(hits: list[dict]) -> str:
    parts = [f'<source id="{n}" document="{h["source"]}" section="{h["heading"]}">\n{h["text"]}\n</source>' for n, h in enumerate(hits, 1)]
    return "\n".join(["<sources>", *parts, "</sources>"])


@dataclass(frozen=True)
class ChatBackend:
    url: str
    model: str
    key: str = ""
    timeout: float = 60.0
    max_tokens: int = 4000

    @classmethod
    def from_environment(cls) -> ChatBackend | None:
        """From LODESTONE_LLM_URL, LODESTONE_LLM_MODEL and LODESTONE_LLM_KEY; None if no address or model is named."""
        url, model = os.environ.get("LODESTONE_LLM_URL", ""), os.environ.get("LODESTONE_LLM_MODEL", "")
        return cls(url, model, os.environ.get("LODESTONE_LLM_KEY", "")) if url and model else None

    @property
    def messages(self) -> bool:
        return self.url.rstrip("/").endswith("/messages")

    def request(self, system: str, user: str, stream: bool = False) -> Request:
        said = [{"role": "user", "content": user}]
        body: dict = {"model": self.model, "max_tokens": self.max_tokens, "stream": stream}
        body |= {"system": system, "messages": said} if self.messages else {"messages": [{"role": "system", "content": system}, *said]}
        headers = {"Content-Type": "application/json"}
        if self.key:
            headers |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"} if self.messages else {"Authorization": f"Bearer {self.key}"}
        return Request(self.url, json.dumps(body).encode(), headers)

    def complete(self, system: str, user: str) -> str:
        """The reply's text."""
        with urlopen(self.request(system, user), timeout=self.timeout) as r:
            got = json.load(r)
        if self.messages:
            text, stop = "".join(b.get("text", "") for b in got.get("content", []) if b.get("type") == "text"), got.get("stop_reason")
        else:
            first = (got.get("choices") or [{}])[0]
            text, stop = (first.get("message") or {}).get("content") or "", first.get("finish_reason")
        self._check(text, stop)
        return text.strip()

    def stream(self, system: str, user: str) -> Iterator[str]:
        """The reply's text as it comes in, from server-sent events."""
        said, stop = False, None
        with urlopen(self.request(system, user, True), timeout=self.timeout) as r:
            for line in r:
                data = line.decode(errors="replace").strip().removeprefix("data:").strip()
                if not data.startswith("{"):
                    continue
                got = json.loads(data)
                if self.messages:
                    delta = got.get("delta") or {}
                    text, stop = delta.get("text") or "", delta.get("stop_reason") or stop
                else:
                    first = (got.get("choices") or [{}])[0]
                    text, stop = (first.get("delta") or {}).get("content") or "", first.get("finish_reason") or stop
                if got.get("type") == "error" or "error" in got:
                    raise BackendError("the service broke off")
                if text:
                    said = said or bool(text.strip())
                    yield text
        self._check("x" if said else "", stop)

    @staticmethod
    def _check(text: str, stop: str | None) -> None:
        if stop in ("refusal", "content_filter"):
            raise BackendError("the model declined to answer")
        if not text.strip():
            raise BackendError(f"the model gave no text ({stop})")

    # what the engine plugs in -----------------------------------------------------------------
    def answers(self, question: str, hits: list[dict]) -> str:
        return self.complete(ANSWER, f"{sources_text(hits)}\n\nQuestion: {question}")

    def streamed(self, question: str, hits: list[dict]) -> Iterator[str]:
        return self.stream(ANSWER, f"{sources_text(hits)}\n\nQuestion: {question}")

    def rewrite(self, question: str) -> str:
        return self.complete(REWRITE, question)

    def condense(self, question: str, history: list[str]) -> str:
        earlier = "\n".join(f"- {h}" for h in history)
        return self.complete(CONDENSE, f"Earlier questions:\n{earlier}\n\nNew question: {question}")

    def judge(self, question: str, contains: str, answer: str, sources: dict[int, str]) -> str:
        cited = "\n".join(f'<source id="{n}">{t}</source>' for n, t in sources.items())
        return self.complete(JUDGE, f"Question: {question}\n\nReference fact: {contains}\n\n<sources>\n{cited}\n</sources>\n\nAnswer:\n{answer}")
