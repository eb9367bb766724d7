"""Providers of rewrites: a chat endpoint over HTTP, a command, and several models under one name each; model cards and settings."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from glob import glob
from pathlib import Path

#: Sampling where neither the card nor the caller says otherwise.
SAMPLING = {"temperature": 0.7, "top_p": 0.95, "repeat_penalty": 1.05, "repeat_last_n": 4096}


def settings(path: str) -> Settings:
    """Settings of a YAML (or JSON) file; patterns in it are relative to its folder."""
    import yaml

    return Settings(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, Path(path).resolve().parent)


@dataclass(frozen=True)
class Settings:
    values: dict
    folder: Path

    def get(self, dotted: str, default=None):
        """The value at a path like "split.seed"; default where any step is missing."""
        at = self.values
        for name in dotted.split("."):
            if not isinstance(at, dict) or name not in at:
                return default
            at = at[name]
        return at

    def files(self, patterns: list[str]) -> list[str]:
        """Paths of all patterns in turn, each pattern's sorted; a file that two patterns match comes twice."""
        return [x for p in patterns for x in sorted(glob(str(self.folder / p), recursive=True))]


@dataclass(frozen=True)
class Card:
    """A served model: where it is, what it is told, how it samples."""

    base_url: str
    model: str
    instruction: str
    name: str = ""
    sampling: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Card:
        missing = [k for k in ("base_url", "model", "instruction") if not values.get(k)]
        if missing:
            raise ValueError(f"the card lacks {', '.join(missing)}")
        known = {k: values[k] for k in ("base_url", "model", "instruction", "name", "sampling") if values.get(k) is not None}
        return cls(**known)

    @classmethod
    def from_settings(cls, config: Settings, section: str = "rewriter") -> Card:
        """The card that a run's settings describe; the instruction is the author's unless the section has one."""
        from quillspark.functions import prompts

        values = dict(config.get(section) or {})
        name = config.get("author.name", prompts.AUTHOR)
        values.setdefault("instruction", prompts.instruction(name, config.get("author.instruction", prompts.INSTRUCTION)))
        values.setdefault("name", name)
        return cls.of(values)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), allow_unicode=True, sort_keys=False)

    def request(self, text: str, before: str = "", **overrides) -> dict:
        """A request's body: defaults, then the card's sampling, then overrides; without temperature nothing is cut from the top."""
        sampling = SAMPLING | self.sampling | {k: v for k, v in overrides.items() if v is not None}
        if sampling["temperature"] == 0:
            sampling["top_p"] = 1.0
        sampling["repetition_penalty"] = sampling["repeat_penalty"]
        context = [f"【上文（仅供参考，不要改写）】\n{before}"] if before else []
        content = "\n\n".join([self.instruction, *context, f"【要改写的段落】\n{text}"])
        return {"model": self.model, "messages": [{"role": "user", "content": content}], "max_tokens": min(2048, int(1.6 * len(text)) + 64)} | sampling


def again(call: Callable[[], str], attempts: int, wait: float) -> str:
    """call(), again after wait, 2 wait, ... seconds; the last failure is the caller's."""
    for k in range(1, attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            time.sleep(wait * k)
    return call()


def chat(card: Card, key_variable: str | None = None, attempts: int = 3, wait: float = 5.0, timeout: float = 600.0, **overrides) -> Callable[[str, str], str]:
    """(text, before) -> rewrite, from an endpoint of chat completions; an error keeps what the endpoint said."""

    def call(text: str, before: str = "") -> str:
        headers = {"Content-Type": "application/json"}
        if key_variable and os.environ.get(key_variable):
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
        body = json.dumps(card.request(text, before, **overrides)).encode()

        def once() -> str:
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{card.base_url.rstrip('/')}/chat/completions", body, headers), timeout=timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                raise RuntimeError(f"HTTP {e.code}: {e.read().decode(errors='replace')[:500]}") from None

        return again(once, attempts, wait)

    return call


def command(argv: list[str], retries: int = 1, wait: float = 0.0, timeout: float = 600.0) -> Callable[[str, str], str]:
    """(text, before) -> rewrite, by a command in an empty folder of its own: `{prompt}` and `{output}` in argv name its two files.

    It is killed at its timeout. Both files live and die within one call, on the machine that makes it.
    """

    def once(text: str, before: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            prompt, output = Path(folder, "prompt.txt"), Path(folder, "output.txt")
            prompt.write_text(f"{before}\n\n{text}" if before else text, encoding="utf-8")
            args = [a.replace("{prompt}", str(prompt)).replace("{output}", str(output)) for a in argv]
            done = subprocess.run(args, cwd=folder, capture_output=True, text=True, timeout=timeout)
            if done.returncode:
                raise RuntimeError(f"exit {done.returncode}: {done.stderr.strip()[-500:]}")
            return output.read_text(encoding="utf-8") if output.exists() else done.stdout

    return lambda text, before="": again(lambda: once(text, before), retries + 1, wait)


def client(spec: dict) -> Callable[[str, str], str]:
    """The provider that settings describe: a command where they have one, else a chat endpoint."""
    if spec.get("command"):
        return command(list(spec["command"]), int(spec.get("retries", 1)), timeout=float(spec.get("timeout", 600)))
    return chat(Card.of(spec), spec.get("key_variable"), timeout=float(spec.get("timeout", 600)))


def worker(call: Callable[[str, str], str], asked: str = "request") -> Callable[[dict], str]:
    """A provider of rows for articles.enriched(): it asks with the row's finished request, so nothing stands before it."""
    return lambda row: call(row[asked], "")


_GATES: dict[str, threading.BoundedSemaphore] = {}
_LOCK = threading.Lock()


def pooled(models: dict[str, tuple[Callable[[dict], str], int]]) -> Callable[[dict], str]:
    """A provider of rows with `model`: each model's own, with at most its number of calls at once in a worker."""

    def call(row: dict) -> str:
        name = row["model"]
        if name not in models:
            raise KeyError(f"no model {name}")
        provider, most = models[name]
        with _LOCK:
            gate = _GATES.setdefault(name, threading.BoundedSemaphore(most))
        with gate:
            return provider(row)

    return call
