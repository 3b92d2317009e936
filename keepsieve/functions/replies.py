"""Replies of typed-question and agent services, read from their JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsieve.functions.texts import unfenced

ANSWER = "struct<type:string,probability:double,choice:string,score:double,probabilities:map<string,double>>"


def answers(body: Column) -> Column:
    """Map from question to its typed answer; null for a body that is no reply."""
    return F.from_json(F.get_json_object(body, "$.answers"), f"map<string,{ANSWER}>")


def probability_of(answer: Column, option: str) -> Column:
    """Probability of an option; of a yes-or-no answer, true has its probability and false the rest."""
    yes = F.when(F.lit(option) == "true", answer["probability"]).when(F.lit(option) == "false", 1 - answer["probability"])
    return F.when(answer["type"] == "boolean", yes).otherwise(answer["probabilities"][option])


def dollars(value: Column) -> Column:
    """An amount given as a number or a numeric text; null otherwise."""
    return value.cast("string").try_cast("double")


def last_text(events: DataFrame, *, reply: str = "reply", order: str = "line_no", line: str = "line") -> DataFrame:
    """(reply, text) of event streams with one JSON event a line: the text of the last event that has one.

    Reads three envelopes: a text part, a result text, and a message content.
    """
    text = F.coalesce(F.get_json_object(line, "$.part.text"), F.get_json_object(line, "$.result"), F.get_json_object(line, "$.message.content[0].text"), F.get_json_object(line, "$.text"))
    known = events.select(reply, order, text.alias("text")).where("text is not null")
    return known.groupBy(reply).agg(F.max_by("text", order).alias("text"))


def title_and_summary(text: Column) -> Column:
    """struct(title, summary) of an agent's reply, with or without a code fence around its JSON."""
    return F.from_json(unfenced(text), "title string, summary string")


def question_problem(kind: str, options: int) -> str | None:
    """What is wrong with a question before it is sent: at most 255 options, two to ten rungs of a score."""
    if kind == "choice" and not 1 <= options <= 255:
        return f"a choice has 1 to 255 options, not {options}"
    if kind == "score" and not 2 <= options <= 10:
        return f"a score has 2 to 10 rungs, not {options}"
    return None


def cookies(text: str) -> dict[str, str]:
    """Names and values of a cookie file: tab-separated browser lines or name=value lines."""
    out = {}
    for line in text.splitlines():
        parts = line.strip().split("\t")
        if len(parts) >= 7:
            out[parts[5]] = parts[6]
        elif "=" in line and not line.lstrip().startswith("#"):
            for pair in line.split(";"):
                name, _, value = pair.strip().partition("=")
                if name:
                    out[name] = value
    return out


def retry_seconds(attempt: int, jitter: float, base: float = 0.25, most: int = 6) -> float:
    """Full-jitter exponential back-off: a fraction ``jitter`` of base * 2**attempt."""
    return jitter * base * 2 ** min(attempt, most)
