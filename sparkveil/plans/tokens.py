"""Replacement tokens, fixed when the plan is built."""

from __future__ import annotations

from sparkveil.plans.config import RedactionConfig


def token(config: RedactionConfig, kind: str, sub: str | None = None) -> str:
    if not config.use_typed_tokens:
        return config.replacement_token
    return f"[{kind}_{sub}]" if sub and config.use_granular_tokens else f"[{kind}]"
