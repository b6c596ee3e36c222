"""Conversion parameters; they become literals in the plan."""

from __future__ import annotations

from dataclasses import dataclass

FAILFAST = "FAILFAST"
DROPMALFORMED = "DROPMALFORMED"
PERMISSIVE = "PERMISSIVE"
MODES = (FAILFAST, DROPMALFORMED, PERMISSIVE)


@dataclass(frozen=True)
class DataOptions:
    # The names and defaults of the conversion settings that users' files hold.
    skip_empty_lines: bool = True
    skip_comment_lines: bool = True
    comment_prefix: str = "#"
    encoding: str = "utf-8"
    system_prompt: str = ""
    custom_user_key: str = "user"
    custom_assistant_key: str = "assistant"
    custom_system_key: str = "system"
    # A JSON null content counts as blank; True turns it into the text "None".
    compat_null: bool = False


class DataFormatError(ValueError):
    """Input that cannot be turned into chat samples."""
