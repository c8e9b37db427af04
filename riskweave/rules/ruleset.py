"""Rule rows ready for matching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from riskweave.rules import catalog as c
from riskweave.rules.dialect import to_java
from riskweave.rules.needles import Needles, needles


def to_java_steps(steps: list[str]) -> str:
    """From the start of the line, each step at its earliest place after the one before; a step once taken is not taken back."""
    *first, last = steps
    return r"\A" + "".join(rf"(?>[^\n]*?(?:{to_java(step)}))" for step in first) + rf"[^\n]*?(?:{to_java(last)})"


@dataclass(frozen=True)
class Rule:
    """One pattern of one rule; a user-supplied rule is one more of these."""

    id: str
    rule: str
    severity: int
    confidence: int
    cwe: str | None
    pattern: str
    message: str
    langs: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    secret: bool = False
    needles: tuple[Needles, ...] = field(init=False, compare=False)
    java: str = field(init=False, compare=False)
    #: Tests a text of one line in linear time, where the pattern would go back and forth.
    linear: str | None = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "needles", needles(self.pattern))
        object.__setattr__(self, "java", to_java(self.pattern))
        form = c.LINEAR_FORMS.get(self.pattern)
        object.__setattr__(self, "linear", to_java_steps(form) if form else None)

    @cached_property
    def template(self) -> str:
        """The message with its first verb only (a message quotes one text)."""
        head, verb, tail = self.message.partition("%s")
        return head + verb + tail.replace("%s", "")


SOURCE = tuple(
    Rule(id_, rule, severity, confidence, cwe, pattern, message, langs, tuple(excludes), secret)
    for id_, rule, severity, confidence, cwe, langs, pattern, message, excludes, secret in c.SOURCE_RULES)
CREDENTIALS = tuple(r for r in SOURCE if r.id in c.CREDENTIAL_RULE_IDS)
EGRESS = tuple(
    Rule(id_, "mcp-network-egress", c.WARNING, c.UNSET, None, pattern, method, langs)
    for id_, method, langs, pattern in c.EGRESS_RULES)
DESCRIPTIONS = tuple(Rule(*row) for row in c.DESCRIPTION_RULES)


def _with_confidence(rows, confidence):
    return tuple(Rule(id_, rule, severity, confidence, cwe, pattern, message)
                 for id_, rule, severity, cwe, pattern, message in rows)


ARGUMENTS = _with_confidence(c.ARGUMENT_RULES, c.CONF_MEDIUM)
RESPONSES = _with_confidence(c.RESPONSE_RULES, c.CONF_HIGH)
HOOKS = _with_confidence(c.HOOK_RULES, c.UNSET)
PYTHON_HOOKS = _with_confidence(c.PYTHON_HOOK_RULES, c.UNSET)


def code_points(ranges: Sequence[tuple[int, int]]) -> str:
    """A character class of code points."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: Invisible characters of any kind (the message tells their number), and those of the tag block.
INVISIBLE = (
    Rule("invisible", "mcp-unicode-injection", c.CRITICAL, c.CONF_MEDIUM, "CWE-116", code_points(c.INVISIBLE_RANGES), ""),
    Rule("invisible-tags", "mcp-unicode-tags-block", c.CRITICAL, c.CONF_HIGH, "CWE-116", code_points([c.TAG_BLOCK]), "Unicode Tags block characters detected — hidden ASCII message embedded in description"),
)
ALL = SOURCE + EGRESS + DESCRIPTIONS + ARGUMENTS + RESPONSES + HOOKS + PYTHON_HOOKS
