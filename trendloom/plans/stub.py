"""A deterministic stand-in for the labelling model, for tests and the benchmark."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from trendloom.schemas import TECHNIQUES

HEX = "0123456789abcdef"


def make_stub():
    """Answers depend on the prompt's digest only; some come fenced, chatty or broken off."""

    def answer(prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        genuine = HEX.index(digest[0]) < 8
        technique = TECHNIQUES[HEX.index(digest[1]) % len(TECHNIQUES)]
        body = f'{{"is_genuine_ai": {str(genuine).lower()}, "ai_technique": "{technique}"}}'
        style = HEX.index(digest[2]) % 4
        return [body, f"```json\n{body}\n```", f"Sure: {body}", body[:-1]][style]

    def score(prompts: Sequence[str]) -> list[str]:
        return [answer(p) for p in prompts]

    return score
