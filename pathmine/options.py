"""Job options. Frozen dataclasses; no operator lives here."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the original tool's defaults (shipped config).
DEFAULT_ENTRY_ID = "1000101"
DEFAULT_UP = "^"
DEFAULT_DOWN = "_"
DEFAULT_SEPARATOR = "|"
DEFAULT_PLACEHOLDER = "<SELF>"
KINDS = ("ast", "cfg", "cdg", "ddg")
SPLIT_FRACTIONS = (("train", 0.89), ("val", 0.035), ("test", 0.075))


@dataclass(frozen=True)
class ExtractOptions:
    max_length: int | None = 8
    max_width: int | None = 2
    max_tree_size: int | None = 200
    max_path_contexts: int = 200
    split_token: bool = False
    separator: str = DEFAULT_SEPARATOR
    up_symbol: str = DEFAULT_UP
    down_symbol: str = DEFAULT_DOWN
    label_placeholder: str = DEFAULT_PLACEHOLDER
    use_parentheses: bool = True
    entry_id: str = DEFAULT_ENTRY_ID
    label_match: str = "contains"  # or "equals" (ddg variable match)
    seed: str = "0"


@dataclass(frozen=True)
class FormatOptions:
    max_paths: dict = field(default_factory=lambda: {"ast": 200, "cfg": 10, "cdg": 50, "ddg": 100})
    include: tuple = ("ast", "cfg", "ddg")
    not_include_methods: tuple = ()
    seed: str = "0"
