"""What a model client is, the echo client, and clients by name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

from ..schemas import REQUIRED_KEYS


class ModelClient(Protocol):
    def generate_batch(self, prompts: list[str]) -> list[str | Exception]:
        """An answer, or the error that took its place, for each prompt, in order."""


class OneByOne:
    """Base of clients that answer one prompt at a time."""

    def generate(self, prompt: str) -> str:
        raise NotImplementedError

    def generate_batch(self, prompts: list[str]) -> list[str | Exception]:
        out: list[str | Exception] = []
        for p in prompts:
            try:
                out.append(self.generate(p))
            except Exception as e:  # noqa: BLE001
                out.append(e)
        return out


class EchoClient(OneByOne):
    """Answers that nothing is reported, for the doi in the prompt; for tests and dry runs."""

    def __init__(self, model: str):
        self.model = model

    def generate(self, prompt: str) -> str:
        found = re.search(r"Article DOI:\s*(\S+)", prompt)
        if not found:
            raise ValueError("the prompt has no line 'Article DOI:'")
        row = {k: {} if k.endswith("_pct") else 0 for k in REQUIRED_KEYS}
        return json.dumps([row | {"doi": found[1], "sample_id": 1, "ses_value": None}])


class VllmClient:
    """Batched inference; needs vllm, which is imported when the first batch comes."""

    def __init__(self, model: str, tensor_parallel_size: int = 1, max_tokens: int = 2048, temperature: float = 0.0):
        self.model, self.tensor_parallel_size, self.max_tokens, self.temperature, self._engine = model, tensor_parallel_size, max_tokens, temperature, None

    def generate_batch(self, prompts: list[str]) -> list[str | Exception]:
        from vllm import LLM, SamplingParams

        self._engine = self._engine or LLM(self.model, dtype="bfloat16", tensor_parallel_size=self.tensor_parallel_size)
        done = self._engine.generate(prompts, SamplingParams(temperature=self.temperature, max_tokens=self.max_tokens))
        return [d.outputs[0].text for d in in_request_order(done)]


def in_request_order(outputs: list) -> list:
    """Outputs by the number of their request: an engine may finish them in any order."""
    return sorted(outputs, key=lambda o: (0, int(o.request_id), "") if str(o.request_id).isdigit() else (1, 0, str(o.request_id)))


class TransformersClient(OneByOne):
    """Needs transformers and torch, which are imported when the first prompt comes."""

    def __init__(self, model: str, max_tokens: int = 2048, temperature: float = 0.0):
        self.model, self.max_tokens, self.temperature, self._pipe = model, max_tokens, temperature, None

    def generate(self, prompt: str) -> str:
        if self._pipe is None:
            import torch
            from transformers import pipeline

            self._pipe = pipeline("text-generation", model=self.model, device_map="auto", torch_dtype=torch.bfloat16)
        drawn = {"do_sample": True, "temperature": self.temperature} if self.temperature > 0 else {"do_sample": False}
        return self._pipe(prompt, max_new_tokens=self.max_tokens, return_full_text=False, **drawn)[0]["generated_text"]


CLIENTS: dict[str, Callable[..., ModelClient]] = {"echo": EchoClient, "vllm": VllmClient, "transformers": TransformersClient}


def build_client(backend: str, model: str, **options) -> ModelClient:
    if backend not in CLIENTS:
        raise ValueError(f"no client {backend!r}; there are {', '.join(sorted(CLIENTS))}")
    return CLIENTS[backend](model, **options)
