"""What a terminal would show of captured output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\x1b\[(?P<args>[^@-~]*)(?:(?P<command>[@-~])|\Z)|\x1b\](?:[^\x07\x1b]|\x1b(?!\\))*(?:\x07|\x1b\\|\Z)|\x1b.?|(?P<sign>.)", re.DOTALL)


def rendered(text: str | None) -> str | None:
    """Carriage returns, cursor moves (C, D, G) and erasing (K) carried out; all other control signs, tabs too, are dropped; so are spaces at the end of lines, and outer space."""
    if text is None:
        return None
    done: list[str] = []
    line: list[str] = []
    at = 0
    for step in _STEP.finditer(text):
        sign, command = step["sign"], step["command"]
        if command:
            digits = "".join(c for c in step["args"] if c.isdigit())
            n = max(1, int(digits)) if digits else 1
            if command == "C":
                at += n
            elif command == "D":
                at = max(0, at - n)
            elif command == "G":
                at = n - 1
            elif command == "K":
                if step["args"] in ("", "0"):
                    line = line[:at]
                elif step["args"] == "1":
                    line = [" "] * min(at, len(line)) + line[at:]
                else:
                    line, at = [], 0
        elif sign == "\n":
            done.append("".join(line))
            line, at = [], 0
        elif sign == "\r":
            at = 0
        elif sign and not (ord(sign) < 32 or ord(sign) == 127):
            line += [" "] * (at + 1 - len(line))
            line[at] = sign
            at += 1
    return "\n".join(x.rstrip(" ") for x in [*done, "".join(line)]).strip()


@F.pandas_udf(T.StringType())
def render_terminal(texts: pd.Series) -> pd.Series:
    return texts.map(rendered, na_action="ignore")
