"""Interfaces of models, and a chain of providers that takes the next where one fails."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol


class LlmClient(Protocol):
    """A provider's model."""

    def generate(self, system: str, message: str) -> str: ...

    def stream(self, system: str, message: str) -> Iterator[str]: ...


class OcrEngine(Protocol):
    """Reads an image: its text and the share of it that text covers."""

    def read(self, image: bytes) -> tuple[str, float]: ...


class VisionClient(Protocol):
    def describe(self, image: bytes, context: str) -> str: ...


class PageRenderer(Protocol):
    def render(self, page: int, dpi: int) -> bytes: ...


def missing(what: str):
    """What stands for a model that isn't installed."""

    def use(*_, **__):
        raise RuntimeError(f"no {what} is installed: pass one to the operator")

    return use


def ocr_image(engine: OcrEngine, image: bytes) -> tuple[str, int, float]:
    """(text, words, area) of an image; nothing where the engine fails."""
    try:
        text, area = engine.read(image)
    except Exception:  # an unreadable image is an empty one
        return "", 0, 0.0
    return text.strip(), len(text.split()), area


def describe_image(client: VisionClient, image: bytes, context: str, limit: int = 1500) -> str:
    """A description, given the start of the page's text; a fixed text where there is none."""
    try:
        said = client.describe(image, context[:limit]).strip()
    except Exception:
        said = ""
    return said or "[no description]"


class Echo:
    """A model that answers with its message."""

    def generate(self, system: str, message: str) -> str:
        return message

    def stream(self, system: str, message: str) -> Iterator[str]:
        yield from message.split(" ")


@dataclass
class Scripted:
    """A model with given answers, or errors to raise, in order."""

    answers: list

    def generate(self, system: str, message: str) -> str:
        said = self.answers.pop(0)
        if isinstance(said, Exception):
            raise said
        return said

    def stream(self, system: str, message: str) -> Iterator[str]:
        yield from self.generate(system, message).split(" ")


# Parts of providers' errors.
_QUOTA = re.compile(r"quota|rate.?limit|429|resource.?exhausted", re.I)
_TRANSIENT = re.compile(r"timeout|timed out|temporar|unavailable|overloaded|500|502|503|504|connection", re.I)
_GONE = re.compile(r"not.?found|404|decommission|deprecated|does not exist|no longer", re.I)


def failure(error: Exception) -> str:
    """quota, gone, transient or other."""
    said = str(error)
    return "quota" if _QUOTA.search(said) else "gone" if _GONE.search(said) else "transient" if _TRANSIENT.search(said) else "other"


@dataclass
class Chain:
    """Providers (name, client). The one that answered last is asked first; one out of quota, gone, or failing three times is passed over.

    Other errors are raised as they are; if every provider fails, RuntimeError.
    """

    providers: list[tuple[str, LlmClient]]
    retries: int = 2
    wait: float = 3.0
    sleep: Callable[[float], None] = time.sleep
    at: int = 0
    name: str | None = None
    _last: Exception | None = field(default=None, repr=False)

    def __post_init__(self):
        if not self.providers:
            raise RuntimeError("no provider is configured")
        first: dict[str, LlmClient] = {}
        for name, client in self.providers:
            first.setdefault(name, client)
        self.providers = list(first.items())

    def _try(self, ask: Callable[[LlmClient], object]):
        for step in range(len(self.providers)):
            place = (self.at + step) % len(self.providers)
            name, client = self.providers[place]
            for attempt in range(self.retries + 1):
                try:
                    said = ask(client)
                except Exception as error:
                    kind, self._last = failure(error), error
                    if kind == "other":
                        raise
                    if kind != "transient":
                        break
                    if attempt < self.retries:
                        self.sleep(self.wait)
                    continue
                self.at, self.name = place, name
                return said
        raise RuntimeError("all providers failed") from self._last

    def generate(self, system: str, message: str) -> str:
        return self._try(lambda client: client.generate(system, message))

    def stream(self, system: str, message: str) -> Iterator[str]:
        """Pieces of an answer; another provider is taken only before the first."""

        def begun(client: LlmClient):
            pieces = iter(client.stream(system, message))
            return next(pieces, None), pieces

        first, rest = self._try(begun)
        if first is not None:
            yield first
        yield from rest
