"""Model clients: text in, text out (L1-L9). No model is shipped; these are the contract, its plumbing and two deterministic stand-ins."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from typing import Any, Protocol


class Client(Protocol):
    """Built once per Python worker from its factory; ``call`` answers one prompt, with a named adapter if the model has several."""

    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str: ...


def call_batch(client: Client, prompts: list[str], workers: int = 8, chunk_size: int | None = None, raise_on_error: bool = False, adapter: str | None = None, callback: Callable | None = None, **options: Any) -> list[str | None]:
    """Answers in the order of the prompts; None where a call failed, unless raise_on_error. One wave of threads per chunk.

    A client with call_many gets a chunk at a time instead; the prompts of a chunk that fails are asked one by one, so that only those that fail themselves give None.
    """
    if not prompts:
        return []
    if hasattr(client, "call_many"):
        return _call_many(client, prompts, chunk_size, raise_on_error, adapter, callback, options)
    size = chunk_size if chunk_size and chunk_size > 0 else len(prompts)
    out: list[str | None] = [None] * len(prompts)

    def one(i: int) -> None:
        error = None
        try:
            out[i] = client.call(prompts[i], adapter=adapter, **options)
        except Exception as e:
            if raise_on_error:
                raise
            error = e
        if callback:
            callback(i, out[i], error)

    for lo in range(0, len(prompts), size):
        with ThreadPoolExecutor(max(1, min(workers, size))) as pool:
            list(pool.map(one, range(lo, min(lo + size, len(prompts)))))
    return out


def _call_many(client: Client, prompts: list[str], chunk_size: int | None, raise_on_error: bool, adapter: str | None, callback: Callable | None, options: dict) -> list[str | None]:
    size = chunk_size if chunk_size and chunk_size > 0 else len(prompts)
    out: list[str | None] = []

    def ask(some: list[str]) -> list[str | None]:
        got = list(client.call_many(some, adapter=adapter, **options))
        if len(got) != len(some):
            raise ValueError(f"{len(got)} answers to {len(some)} prompts")
        return got

    for lo in range(0, len(prompts), size):
        wave = prompts[lo : lo + size]
        errors: list[Exception | None] = [None] * len(wave)
        try:
            said = ask(wave)
        except Exception as e:
            if raise_on_error:
                raise
            said, errors = [None] * len(wave), [e] * len(wave)
            for i, p in enumerate(wave if len(wave) > 1 else []):
                try:
                    said[i], errors[i] = ask([p])[0], None
                except Exception as own:
                    errors[i] = own
        for i, (answer, error) in enumerate(zip(said, errors)):
            if callback:
                callback(lo + i, answer, error)
        out += said
    return out


_BUILT: dict[bytes, Client] = {}


def shared(factory: Callable[[], Client]) -> Client:
    """The one client that a Python worker builds from a factory, for all stages and tasks that it runs."""
    from pyspark import cloudpickle

    key = cloudpickle.dumps(factory)
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


def length_buckets(lengths: list[int], size: int = 8, slack: float = 1.3, extra: int = 50) -> list[list[int]]:
    """Places of prompts by rising length, cut where a batch is full or the next is much longer than its longest."""
    out: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if not out or len(out[-1]) >= size or lengths[i] > slack * longest + extra:
            out.append([])
            longest = 0
        out[-1].append(i)
        longest = max(longest, lengths[i])
    return out


def generation_options(defaults: dict, adapter: dict | None = None, call: dict | None = None) -> dict:
    """Client defaults, then the adapter's, then what the call sets."""
    return defaults | (adapter or {}) | {k: v for k, v in (call or {}).items() if v is not None}


def with_retries(max_retries: int = 5, base_delay: float = 1.0, max_delay: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Retries every failure with doubling delays and full jitter; the last one is raised."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(*a, **k):
            for attempt in range(max_retries + 1):
                try:
                    return f(*a, **k)
                except Exception:
                    if attempt == max_retries:
                        raise
                    sleep(random.uniform(0, min(max_delay, base_delay * 2**attempt)))

        return run

    return around


class EchoClient:
    """Answers with the prompt itself."""

    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str:
        return prompt


_LINE = re.compile(r"^(\d+) \('(.*)', '(.*)'\)$", re.M)
_UNDER = re.compile(r"^The entire chunk is under: '(.*)'$", re.M)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)
_HEADING = re.compile(r"<h1[^>]*>(.*?)</h1>", re.S | re.I)


class HeuristicClient:
    """A stand-in that reads prompts by rule, to exercise the plumbing: it keeps titles and headings and answers with them. It is no model."""

    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str:
        if adapter == "pruner":
            under = _UNDER.search(prompt)
            keep = [int(i) for i, path, text in _LINE.findall(prompt) if re.search(r"/(title|h1)(\[\d+\])?/?$", (under[1] if under else "") + path) or "<h1" in text]
            return json.dumps(keep)
        text = lambda m: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", m[1])).strip() if m else None
        title, heading = text(_TITLE.search(prompt)), text(_HEADING.search(prompt))
        if adapter == "schema":
            return "```json\n" + json.dumps({"title": title, "heading": heading}, ensure_ascii=False) + "\n```"
        return json.dumps({"answer": heading or title}, ensure_ascii=False)


class RemoteClient:
    """An HTTP chat-completions endpoint; needs the requests package and a network when called."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 60, **defaults: Any):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout
        self.defaults = {"temperature": 0, "top_p": 1, "max_tokens": 8192} | defaults

    @with_retries(10, 0.5, 5.0)
    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str:
        import requests

        body = generation_options(self.defaults, None, options) | {"model": adapter or self.model, "messages": [{"role": "system", "content": "You read web pages."}, {"role": "user", "content": prompt}]}
        got = requests.post(self.url, json=body, headers={"Authorization": f"Bearer {self.key}"} if self.key else {}, timeout=self.timeout)
        got.raise_for_status()
        return got.json()["choices"][0]["message"]["content"]


class LocalModelClient:
    """A local causal language model with optional adapters; needs torch and transformers, which are imported when it is built."""

    def __init__(self, model: str, adapters: dict[str, str] | None = None, batch: int = 8, **defaults: Any):
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.torch, self.batch = torch, batch
        self.tokenizer = AutoTokenizer.from_pretrained(model, padding_side="left")
        self.model = AutoModelForCausalLM.from_pretrained(model)
        if adapters:
            from peft import PeftModel

            names = list(adapters)
            self.model = PeftModel.from_pretrained(self.model, adapters[names[0]], adapter_name=names[0])
            for n in names[1:]:
                self.model.load_adapter(adapters[n], adapter_name=n)
        self.adapters, self.defaults = adapters or {}, {"max_new_tokens": 512, "temperature": 0.0} | defaults

    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str:
        return self.call_many([prompt], adapter, **options)[0]

    def call_many(self, prompts: list[str], adapter: str | None = None, **options: Any) -> list[str | None]:
        if adapter in self.adapters:
            self.model.set_adapter(adapter)
        opts = generation_options(self.defaults, None, options)
        opts["max_new_tokens"] = opts.pop("max_tokens", opts["max_new_tokens"])
        if not opts.get("temperature"):
            opts |= {"do_sample": False}
            opts.pop("temperature", None)
        lengths = [len(x) for x in self.tokenizer(prompts)["input_ids"]]
        out: list[str | None] = [None] * len(prompts)
        for group in length_buckets(lengths, self.batch):
            x = self.tokenizer([prompts[i] for i in group], return_tensors="pt", padding=True)
            with self.torch.no_grad():
                y = self.model.generate(**x, **opts)
            for i, t in zip(group, self.tokenizer.batch_decode(y[:, x["input_ids"].shape[1] :], skip_special_tokens=True)):
                out[i] = t
        return out


class BatchEngineClient:
    """A batch inference engine with adapters beside one model; needs the vllm package, which is imported when the client is built."""

    def __init__(self, model: str, adapters: dict[str, str] | None = None, context: int = 8192, **defaults: Any):
        from vllm import LLM

        self.adapters, self.context, self.defaults = adapters or {}, context, {"max_tokens": 512, "temperature": 0.0} | defaults
        more = {"enable_lora": True, "max_loras": min(len(self.adapters), 3)} if self.adapters else {}
        self.engine = LLM(model=model, max_model_len=context, **more)

    def room(self, max_tokens: int) -> int:
        """Tokens that a prompt may have: what the answer leaves of the context, half of it at least."""
        return max(self.context - max_tokens - 1, self.context // 2)

    def call(self, prompt: str, adapter: str | None = None, **options: Any) -> str:
        return self.call_many([prompt], adapter, **options)[0]

    def call_many(self, prompts: list[str], adapter: str | None = None, **options: Any) -> list[str | None]:
        from vllm import SamplingParams
        from vllm.lora.request import LoRARequest

        opts = generation_options(self.defaults, None, options)
        how = SamplingParams(truncate_prompt_tokens=self.room(opts["max_tokens"]), **opts)
        names = list(self.adapters)
        lora = LoRARequest(adapter, names.index(adapter) + 1, self.adapters[adapter]) if adapter in self.adapters else None
        return [x.outputs[0].text if x.outputs else None for x in self.engine.generate(prompts, how, lora_request=lora)]
