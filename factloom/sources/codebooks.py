"""Codebooks: reading, validation and prompts (S16, N06). They are small files, read on the driver."""

from __future__ import annotations

import json

#: Fields that a codebook and its classes must have.
TOP_FIELDS = ("name", "version", "instructions", "output_instructions")
CLASS_FIELDS = ("label", "label_definition", "clarification", "negative_clarification")
#: Tokens of a prompt that name the country.
COUNTRY_TOKENS = ("{country}", "{country_iso}")


def load(path: str) -> dict:
    """A validated codebook from a JSON or (if a YAML reader is installed) YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or raw.get("codebook") is None:
        raise ValueError(f"no 'codebook' in {path}")
    return validated(raw["codebook"])


def validated(book: dict) -> dict:
    """The codebook itself, or an error that names what it lacks."""
    lacks = [f for f in TOP_FIELDS if f not in book]
    if lacks:
        raise ValueError(f"codebook lacks {', '.join(lacks)}")
    for at, entry in enumerate(book.get("classes") or [], 1):
        name = entry.get("label", f"number {at}")
        lacks = [f for f in CLASS_FIELDS if f not in entry]
        if lacks:
            raise ValueError(f"class {name} lacks {', '.join(lacks)}")
        for kind in ("positive_examples", "negative_examples"):
            for n, example in enumerate(entry.get(kind) or [], 1):
                if example.get("text") is None or example.get("reasoning") is None:
                    raise ValueError(f"class {name}: {kind} {n} lacks text or reasoning")
    return book


def labels(book: dict) -> list[str]:
    """Labels in the order of the classes."""
    return [entry["label"] for entry in book.get("classes") or []]


# The headings of a prompt and of its sections, here and in ``prompt``.


def _criteria(title: str, kind: str, items: list[str] | str, removed: set[str]) -> str:
    listed = [items] if isinstance(items, str) else list(items or [])
    kept = [f"- {x}\n" for n, x in enumerate(listed, 1) if f"{kind}_{n}" not in removed]
    return f"**{title}:**\n{''.join(kept)}\n" if kept else ""


def _class_text(entry: dict, extra: list[str], removed: set[str], without: set[str]) -> str:
    label = entry["label"]
    positive, negative = [], []
    for n, x in enumerate(entry.get("positive_examples") or [], 1):
        answer = json.dumps({"label": label, **dict.fromkeys(extra), "reasoning": x["reasoning"]}, indent=2, ensure_ascii=False)
        positive.append(f"Example {n}:\nText: {x['text'].strip()}\n\nExpected output:\n{answer}\n\n")
    for n, x in enumerate(entry.get("negative_examples") or [], 1):
        negative.append(f"Example {n}:\nText: {x['text'].strip()}\n\nWhy not {label}: {x['reasoning'].strip()}\n\n")
    sections = {
        "label_definition": f"**Definition:** {entry['label_definition']}\n\n",
        "clarifications": _criteria("Inclusion criteria", "clarification", entry["clarification"], removed),
        "negative_clarifications": _criteria("Exclusion criteria", "negative_clarification", entry["negative_clarification"], removed),
        "positive_examples": f"**Positive examples for {label}:**\n\n{''.join(positive)}" if positive else "",
        "negative_examples": f"**Negative examples (not {label}):**\n\n{''.join(negative)}" if negative else "",
    }
    return f"## {label}\n\n" + "".join(text for name, text in sections.items() if name not in without)


def prompt(
    book: dict,
    order: list[int] | None = None,
    removed: dict[str, set[str]] | None = None,
    without: set[str] = frozenset(),
    country: str = "united states",
    country_iso: str = "US",
) -> str:
    """Instructions, classes in order, examples and output instructions as one text.

    ``order`` has places of classes from 0, ``removed`` names criteria to leave
    out by label (``clarification_2``), ``without`` whole sections. The country
    is put in for its tokens; a token that is left is an error.
    """
    classes = list(book.get("classes") or [])
    if order is not None:
        classes = [classes[i] for i in order]
    extra = [f["name"] for f in book.get("extra_output_fields") or []]
    text = f"{book['instructions']}\n\n"
    if classes:
        text += "# Class Definitions\n\n" + "".join(_class_text(c, extra, set((removed or {}).get(c["label"], ())), set(without)) for c in classes)
    shown = []
    for n, x in enumerate(book.get("examples") or [], 1):
        answer = json.dumps(x["output"], indent=2, ensure_ascii=False)
        shown.append(f"## Example {n}\n\n**Act:** {x['input']['act_name']} ({x['input']['year']})\n\n**Text:** {x['input']['text'].strip()}\n\n**Expected output:**\n```json\n{answer}\n```\n\n")
    if shown:
        text += "# Examples\n\n" + "".join(shown)
    if "output_instructions" not in without:
        text += f"# Output Instructions\n\n{book['output_instructions']}\n"
    for token, value in zip(COUNTRY_TOKENS, (country.title(), country_iso)):
        text = text.replace(token, value)
    if any(token in text for token in COUNTRY_TOKENS):
        raise ValueError("a country token is left in the prompt")
    return text
