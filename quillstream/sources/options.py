"""Settings of a run: command line over environment over configuration file over default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from quillstream.operators.paths import languages


@dataclass(frozen=True)
class Options:
    provider: str = "auto"
    target_languages: tuple[str, ...] = ("tr",)
    source_path: str = "docs"
    include_glob: str = "**/*.md"
    glossary_path: str = ".doc-terms.json"
    output_path_template: str = "docs/{lang}/{relativePath}"
    base_branch: str | None = None
    pr_mode: bool = True
    dry_run: bool = False
    fail_on_stale_translations: bool = False
    max_parallel: int = 4
    verbose: bool = False


def _bool(text: str) -> bool:
    low = str(text).strip().lower()
    if low not in ("true", "false"):
        raise ValueError(f"not a boolean: {text!r}")
    return low == "true"


def _positive(text: str) -> int | None:
    text = str(text).strip()
    return int(text) if text.isdigit() and int(text) > 0 else None


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def resolve(cli: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, config_path: str | None = None) -> Options:
    """An environment input is looked up with hyphens, then with underscores; blanks count as not given. A dry run is asked for
    or is what is left when there is no pull request."""
    cli, env = cli or {}, env or {}
    config: dict = {}
    if config_path:
        if not os.path.exists(config_path):
            raise FileNotFoundError(config_path)
        with open(config_path, encoding="utf-8-sig") as file:
            config = json.load(file)

    def given(name: str) -> object | None:
        upper = name.upper()
        for value in (cli.get(name), env.get("INPUT_" + upper.replace("_", "-")), env.get("INPUT_" + upper), config.get(_camel(name))):
            if value is not None and str(value).strip():
                return value
        return None

    found: dict[str, object] = {}
    for f in fields(Options):
        value = given(f.name)
        if value is None:
            continue
        if f.name == "target_languages":
            value = tuple(languages(value if isinstance(value, str) else ",".join(value)))
        elif isinstance(f.default, bool):
            value = value if isinstance(value, bool) else _bool(value)
        elif isinstance(f.default, int):
            value = _positive(value)
            if value is None:
                continue
        found[f.name] = value
    if "dry_run" not in found and "pr_mode" in found:
        found["dry_run"] = not found["pr_mode"]
    if found.get("dry_run"):
        found["pr_mode"] = False
    return Options(**found)


def published(options: Options, given: Mapping[str, str | None]) -> dict[str, str]:
    """The settings that translators look up in their environment: keys and models as given, where they aren't blank, the provider and
    how many calls may be in flight. Merge it into what ``translate.select`` gets, or into ``os.environ``."""
    found = {**given, "INPUT_LLM_PROVIDER": options.provider, "INPUT_MAX_PARALLEL_REQUESTS": str(options.max_parallel)}
    return {k: v for k, v in found.items() if v is not None and v.strip()}


def repository(text: str) -> tuple[str, str]:
    """Owner and name of owner/name."""
    owner, slash, name = text.partition("/")
    if not slash or not owner or not name:
        raise ValueError(f"not an owner/name: {text!r}")
    return owner, name
