"""A client for chat-completion services that answer with a JSON object; the sender is injected, so tests need no network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from marlinspike.vocab import CERTIFICATES, EXPERIENCE_LEVELS

PROMPT_VERSION = "2"
#: Sends (url, headers, body); gives (status, headers, body).
Send = Callable[[str, dict[str, str], bytes], tuple[int, dict[str, str], bytes]]


def response_schema() -> dict:
    """JSON schema of the object that is asked for: a level and certificates, each with quote and basis."""
    basis = {"type": "string", "enum": ["stated", "inferred"]}

    def item(name: str, values: list[str]) -> dict:
        return {"type": "object", "properties": {name: {"type": "string", "enum": values}, "quote": {"type": "string"}, "basis": basis}, "required": [name, "quote", "basis"], "additionalProperties": False}

    level = {"anyOf": [item("value", EXPERIENCE_LEVELS), {"type": "null"}]}
    return {"type": "object", "properties": {"experience_level": level, "required_certificates": {"type": "array", "items": item("key", list(CERTIFICATES))}}, "required": ["experience_level", "required_certificates"], "additionalProperties": False}


#: What a level means in years; the rules' own thresholds, fixed values.
LEVELS_BY_YEARS = (("entry", "none asked for, or trainees wanted"), ("junior", "under 2 years"), ("mid", "2 years up to 4"), ("senior", "5 years and more"))


def prompt(text: str) -> str:
    """The question about one text: what counts as a level and as a required certificate, and what doesn't."""
    levels = "; ".join(f"{level}: {years}" for level, years in LEVELS_BY_YEARS)
    return (
        "Below is a job posting. Answer two things about it as JSON: experience_level and required_certificates. "
        "For each answer copy the words it rests on as its quote, letter by letter from the posting; an answer without such words is no answer.\n"
        f"Level, by the years asked for: {levels}. Years decide even where leading others is mentioned; lead is for required leadership without any number, "
        "and experience that is asked for without a number is junior. The length of the contract, the age of ships and how often a course must be renewed are not experience, nor are the duties. "
        "Nothing asked for: null. The basis is stated if the posting says it outright, inferred if it only follows.\n"
        f"Certificates, by these keys only: {', '.join(CERTIFICATES)}. Count what an applicant has to hold already. "
        "What is recommended, preferred, welcome or an advantage is not required. Knowing or following a standard is not holding it. "
        "If the document that is required has no key of its own, leave it out rather than take a similar key; a visa of one country is not that of another. Nothing required: an empty list.\n\n"
        + text
    )


def pause_asked(header: str | None, most: float = 60.0, now: datetime | None = None) -> float | None:
    """Seconds that a Retry-After header (seconds or a date) asks for, at most `most`; null without a readable one."""
    if not header:
        return None
    try:
        seconds = float(header)
    except ValueError:
        try:
            seconds = (parsedate_to_datetime(header) - (now or datetime.now(UTC))).total_seconds()
        except (TypeError, ValueError):
            return None
    return min(most, max(0.0, seconds))


def send(url: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], bytes]:
    """One POST."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=60) as answer:  # noqa: S310
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()


class ChatClient:
    """extract(text) asks the service; transport errors, 429, 5xx and unreadable answers are tried again, other 4xx raise at once."""

    def __init__(self, url: str, model: str, key: str, retries: int = 2, sender: Send = send, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.key, self.retries, self._send, self._sleep = url, model, key, retries, sender, sleep

    def extract(self, text: str) -> dict:
        ask = {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt(text)}], "response_format": {"type": "json_schema", "json_schema": {"name": "posting", "strict": True, "schema": response_schema()}}}
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        error: Exception = ConnectionError("no answer")
        for k in range(self.retries + 1):
            wait = None
            try:
                status, got, body = self._send(self.url, headers, json.dumps(ask).encode())
                if status == 200:
                    return dict(json.loads(json.loads(body)["choices"][0]["message"]["content"]))
                if status < 500 and status != 429:
                    raise PermissionError(f"status {status}")
                error, wait = ConnectionError(f"status {status}"), pause_asked({k.lower(): v for k, v in got.items()}.get("retry-after"))
            except (urllib.error.URLError, TimeoutError, ValueError, KeyError, IndexError, TypeError) as e:
                error = e
            if k < self.retries:
                self._sleep(wait if wait is not None else min(8.0, 0.5 * 2**k))
        raise ConnectionError(str(error))
