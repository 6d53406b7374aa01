"""Instructions to models, and what is asked of them around retrieval."""

from __future__ import annotations

import re

from foliant.chat.models import LlmClient

ANSWER = "Answer only from the context given. Say so if the context does not hold the answer. Name the sources in brackets, and answer in the question's language."
SUMMARY = "Sum up the document from the parts given: its subject, main points and conclusions, in the language of the document."
EXPAND = "Write other wordings of the search query, one on a line, without numbers or comments."
REWRITE = "Rewrite the last question so that it can be understood without the conversation. Return the question alone."
JUDGE = 'Grade the answer from 1 to 5 for faithfulness, relevance and correctness. Return one JSON object with these keys and "rationale".'
NOTHING = "Nothing in the documents matches this question."


def variants(text: str) -> list[str]:
    """A model's lines without bullets, numbers and quotes, without repeats in any case."""
    lines = (re.sub(r"^(?:[-*•]|\d+[.)])\s*", "", x.strip()).strip("\"' \t") for x in text.splitlines())
    return list({x.lower(): x for x in reversed([y for y in lines if y])}.values())[::-1]


def expanded(client: LlmClient, query: str, n: int) -> list[str]:
    """query and up to n other wordings; query alone where the model fails."""
    if n <= 0:
        return [query]
    try:
        said = variants(client.generate(EXPAND, f"{n} wordings of: {query}"))
    except Exception:
        return [query]
    return [query, *[v for v in said if v.lower() != query.lower()][:n]]


def rewritten(client: LlmClient, query: str, transcript: str) -> str:
    """query made to stand alone; as it is without history or where the model fails."""
    if not transcript.strip():
        return query
    try:
        return client.generate(REWRITE, f"{transcript}\n\nLast question: {query}").strip() or query
    except Exception:
        return query


def question_message(question: str, context: str, history: str = "") -> str:
    before = f"Conversation so far:\n{history}\n\n" if history.strip() else ""
    return f"{before}Context:\n{context}\n\nQuestion: {question}"


def summary_message(name: str, context: str) -> str:
    return f"Document: {name}\n\n{context}"


def asked(client: LlmClient, question: str, context: str, history: str = "") -> str:
    """An answer from a packed context; a fixed one where the context is empty."""
    return client.generate(ANSWER, question_message(question, context, history)) if context.strip() else NOTHING


def summarised(client: LlmClient, name: str, context: str) -> str:
    return client.generate(SUMMARY, summary_message(name, context)) if context.strip() else NOTHING
