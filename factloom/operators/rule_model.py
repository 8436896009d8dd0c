"""A rule-based stand-in for a model, so that calls, votes and behavioural tests run without one.

It reads the classes out of the prompt it is given: a class holds if the text
has a word that its definition quotes, and a class that quotes none holds for
the rest. So it changes its answers when the codebook does.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

_CLASS = re.compile(r"^## (.+?)\n\n(.*?)(?=^## |^# |\Z)", re.M | re.S)
_DEFINITION = re.compile(r"\*\*Definition:\*\* (.*?)\n\n", re.S)


def task_text(prompt: str) -> str:
    """The text that a few-shot prompt asks about."""
    at = prompt.rfind("Input:\n")
    return prompt[at + 7 :].removesuffix("\n\nOutput:\n") if at >= 0 else prompt


def digit(text: str, sample: object) -> int:
    """0 to 15, by the first hexadecimal digit of the md5 of 'text#sample'."""
    return int(hashlib.md5(f"{text}#{sample}".encode()).hexdigest()[0], 16)


def classes_of(system: str) -> list[tuple[str, str, str]]:
    """Label, definition and whole section of each class of a codebook's prompt."""
    body = system.partition("# Class Definitions")[2].partition("# Output Instructions")[0]
    return [(label, found.group(1) if (found := _DEFINITION.search(text)) else "", text) for label, text in _CLASS.findall(body)]


@dataclass(frozen=True)
class RuleModel:
    """``follows`` is what decides: ``definitions``, or the ``names`` of labels (given with their words in ``words``), or the ``order`` of classes (the first one's label for every text of even length)."""

    follows: str = "definitions"
    words: tuple[tuple[str, tuple[str, ...]], ...] = ()
    obeys_rules: bool = True

    def __call__(self, request: dict[str, object]) -> str:
        prompt, classes = str(request["prompt"]), classes_of(str(request["system"]))
        for lead, part in (("Definition: ", 1), ("Text: ", 2)):
            if f"\n\n{lead}" in prompt and "Name the label that it belongs to." in prompt:
                return self._recall(prompt.partition(f"\n\n{lead}")[2].partition("\n\nReturn your answer")[0], classes, part)
        text = task_text(prompt)
        label = self._label(text, classes)
        return json.dumps({"label": label, "reasoning": "by rule", "measures": self._measures(text)})

    def _recall(self, text: str, classes: list[tuple[str, str, str]], part: int) -> str:
        for entry in classes:
            if text.strip() in entry[part]:
                negative = part == 2 and f"Why not {entry[0]}:" in entry[2].partition(text.strip())[2].partition("Text: ")[0]
                other = [x[0] for x in classes if x[0] != entry[0]]
                return json.dumps({"label": other[0] if negative and other else entry[0], "reasoning": "recalled"})
        return json.dumps({"label": None, "reasoning": "not in the codebook"})

    def _label(self, text: str, classes: list[tuple[str, str, str]]) -> str | None:
        if self.follows == "order" and len(text) % 2 == 0:
            return classes[0][0]
        named, rest = dict(self.words), None
        for label, definition, section in classes:
            quoted = named.get(label, ()) if self.follows == "names" else re.findall('"([^"]+)"', definition)
            barred = self.obeys_rules and "does not apply if the document discusses an elephant" in section and "elephant" in text.lower()
            if not quoted:
                rest = rest or label
            elif not barred and any(w in text.lower() for w in quoted):
                return label
        return rest or classes[-1][0]

    def _measures(self, text: str) -> list[dict]:
        names = re.findall(r"[A-Z]\w+(?: [A-Z]\w+)* Act of \d{4}", text)
        return [{"name": n, "country": "US", "discusses_motivation": True, "discusses_timing": False, "discusses_magnitude": False} for n in names]


def sampled_detection(request: dict[str, object]) -> str:
    """A detector whose answers vary by sample: a digit of 15 fails, 14 is no JSON, below 8 there is an act."""
    text = task_text(str(request["prompt"]))
    d = digit(text, request["sample"])
    if d == 15:
        raise ValueError("refused")
    if d == 14:
        return "I can't say."
    return f"```json\n{json.dumps({'contains_act': d < 8, 'act_name': f'Act {d % 3}' if d < 8 else None, 'confidence': 0.9, 'reasoning': f'digit {d}'})}\n```"


def sampled_motivation(request: dict[str, object]) -> str:
    """A classifier of motivations that varies by sample."""
    d = digit(task_text(str(request["prompt"])), request["sample"])
    if d == 15:
        raise ValueError("529 overloaded")
    names = ("Long-run", "Deficit-driven", "Spending-driven", "Countercyclical")
    out = {"motivation": names[d % 4], "exogenous": d % 4 < 2, "confidence": 0.5, "reasoning": f"digit {d}", "evidence": [f"e{d}"] if d > 4 else []}
    return json.dumps(out | ({"needs_expert_review": True, "review_reason": f"r{d}"} if d % 5 == 0 else {}))


def sampled_changes(request: dict[str, object]) -> str:
    """An extractor of changes: one or two quarters a sample."""
    d = digit(task_text(str(request["prompt"])), request["sample"])
    changes = [{"timing_quarter": f"200{d % 3}-Q1", "magnitude_billions": d / 4, "present_value_quarter": None if d % 2 else "2000-Q1", "confidence": d / 16}]
    if d > 9:
        changes.append({"timing_quarter": "2009-Q4", "magnitude_billions": -1.5, "source": f"s{d}"})
    return json.dumps({"changes": changes, "reasoning": ""})


def sampled_acts(request: dict[str, object]) -> str:
    """An extractor of acts: none, or one or two with a passage, spelled in two ways."""
    d = digit(task_text(str(request["prompt"])), request["sample"])
    if d == 15:
        return "none"
    acts = [{"act_name": f"{'THE' if d % 2 else 'The'} Act {d % 3}", "year": 1990 + d % 2, "passages": [f"passage of act {d % 3}"], "reasoning": f"digit {d}" if d % 4 else ""}] if d > 3 else []
    if d > 11:
        acts.append({"act_name": "Other", "year": 2000, "passages": [{"text": "one more passage"}]})
    return json.dumps({"acts": acts, "no_acts_found": not acts})


def improving_evidence(request: dict[str, object]) -> str:
    """An extractor of evidence that is invalid at first for a third of the texts, and stays so for a ninth."""
    text, attempt = task_text(str(request["prompt"])), int(request["attempt"])
    if len(text) % 3 == 0 and (attempt == 1 or len(text) % 9 == 0):
        return json.dumps({"evidence": [{"quote": "q"}], "enacted_signals": [], "timing_signals": []})
    return json.dumps({"evidence": [{"quote": text[:10], "signal": "s"}], "enacted_signals": [], "timing_signals": []})


def ordered_evidence(request: dict[str, object]) -> str:
    """An extractor of evidence that names the first class of its prompt for texts of even length: it must fail the test of orders."""
    text, first = task_text(str(request["prompt"])), classes_of(str(request["system"]))[0][0]
    evidence = [{"quote": text[:10], "signal": first if len(text) % 2 == 0 else "s"}] if text else []
    return json.dumps({"evidence": evidence, "enacted_signals": [], "timing_signals": []})
