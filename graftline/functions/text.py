"""Text functions of prompts, posts and logs as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline.runtime import clean_strip

# Fixed values of the data format.
IMAGE_COMMENT, REPOST, REPOST_LONG, COMMENT = "图片评论", "转发", "转发微博", "评论"
CSTART, CEND, PSEP = "<|cstart|>", "<|cend|>", "<|psep|>"
SPANS_START, SPANS_END = "<POTENTIAL_SPANS>", "</POTENTIAL_SPANS>"
FENCE, IM_START, IM_END = "```", "<|im_start|>", "<|im_end|>"
SEPARATORS = (",", "，", "、", ";", "；", "|", " ")


def strip_repost_tail(c: Column) -> Column:
    """Text before the first ``//@`` or ``/@`` without white space at its end; without such a mark, stripped."""
    cut = F.regexp_replace(F.regexp_replace(c, r"(?s)//?@.*$", ""), r"(?U)\s+$", "")
    return F.when(c.contains("/@"), cut).otherwise(clean_strip(c))


def without_markers(c: Column) -> Column:
    return clean_strip(F.replace(F.replace(c, F.lit(CSTART), F.lit("")), F.lit(CEND), F.lit("")))


def between_markers(c: Column) -> Column:
    """Between the first start and the next end marker; the whole text where a marker is missing."""
    tail = F.regexp_extract(c, r"(?s)<\|cstart\|>(.*?)<\|cend\|>", 1)
    return F.when(c.rlike(r"(?s)<\|cstart\|>.*?<\|cend\|>"), tail).otherwise(c)


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1B\[[0-?]*[ -/]*[@-~]", "")


def _after(c: Column, n: int | Column) -> Column:
    """The text from its character n on, counted from 0."""
    return F.substring(c, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.length(c))


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(c), then), 0)


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def _unfenced(c: Column) -> Column:
    """Without the code fence that a text begins or ends with."""
    def opened(t: Column) -> Column:
        inner = lambda x: F.when(F.lower(F.substring(x, 1, 4)) == "json", _after(x, 4)).otherwise(x)
        return F.when(t.startswith(FENCE), _let(clean_strip(_after(t, len(FENCE))), inner)).otherwise(t)

    closed = lambda t: F.when(t.endswith(FENCE), F.substring(t, F.lit(1), F.length(t) - len(FENCE))).otherwise(t)
    return clean_strip(_let(clean_strip(_let(clean_strip(c), opened)), closed))


def _unmarked(line: Column) -> Column:
    """A line without the template's marks at its head and end."""
    def spoken(x: Column) -> Column:  # by whom the turn is
        role = lambda r: F.when(F.lower(r).startswith("assistant"), _left(_after(r, len("assistant")))).when(F.lower(r).startswith("user"), _left(_after(r, len("user"))))
        return F.when(F.lower(_left(x)).startswith(IM_START), F.coalesce(_let(_left(_after(_left(x), len(IM_START))), role), x)).otherwise(x)

    ended = lambda x: F.when(F.lower(clean_strip(x)).endswith(IM_END), F.regexp_replace(x, r"(?U)\S{%d}\s*$" % len(IM_END), "")).otherwise(x)
    named = lambda x: F.when(F.lower(_left(x)).startswith("[user") & x.contains("]"), _left(_after(x, F.locate("]", x)))).otherwise(x)
    return _let(_let(_let(line, spoken), ended), named)


def strip_chat_artifacts(c: Column) -> Column:
    """Without a code fence around it, and without chat template marks at the heads and ends of its lines."""
    return clean_strip(F.array_join(F.transform(F.split(_unfenced(c), "\n", -1), _unmarked), "\n"))


def interact_header(c: Column) -> Column:
    """Struct of an INTERACT header's tag (0, 1 or null without one), the body after it and a note on its form.

    A header in brackets ends with its bracket and may hold other words; a bare one is a line of its own.
    """
    def parts(t: Column) -> Column:
        line = F.substring_index(t, "\n", 1)
        boxed = line.startswith("[") & line.contains("]")
        return F.struct(t.alias("text"), boxed.alias("boxed"), F.when(boxed, F.substring_index(_after(line, 1), "]", 1)).otherwise(line).alias("head"))

    def value(p: Column) -> Column:
        at = F.locate("INTERACT", F.upper(p["head"]))
        return F.struct(p["text"].alias("text"), p["boxed"].alias("boxed"), p["head"].alias("head"), at.alias("at"), F.translate(_after(p["head"], at + len("INTERACT") - 1), " \t\r", "").alias("value"))

    def header(p: Column) -> Column:
        v = p["value"]
        told = (p["at"] > 0) & F.substring(v, 1, 1).isin(":", "=") & F.substring(v, 2, 1).isin("0", "1") & (p["boxed"] | ((p["at"] == 1) & (F.length(v) == 2)))
        rest = _after(p["text"], F.length(p["head"]) + F.when(p["boxed"], 2).otherwise(0))
        return F.struct(
            F.when(told, F.substring(v, 2, 1)).try_cast("int").alias("tag"), clean_strip(F.when(told, rest).otherwise(p["text"])).alias("body"),
            F.when(told, F.when(p["boxed"], "peeled_header_bracket").otherwise("peeled_header_nobracket")).alias("note"))

    return _let(_let(_let(clean_strip(c), parts), value), header)


def interact_tag(c: Column) -> Column:
    """0 or 1 of an INTERACT header, in brackets or bare; null without one."""
    return interact_header(c).tag


def username(c: Column) -> Column:
    """The first ``username:`` line's value, trimmed; empty without one."""
    return F.regexp_extract(c, r"(?im)^\s*username:\s*(.+?)\s*$", 1)


def candidate_block(c: Column, last: bool = True) -> Column:
    """The candidates' block: of the last header in training data, of the first in checks."""
    return F.regexp_extract(c, r"(?s).*<POTENTIAL_SPANS>(.*?)(?:</POTENTIAL_SPANS>|$)" if last else r"(?s)<POTENTIAL_SPANS>(.*?)(?:</POTENTIAL_SPANS>|$)", 1)


def candidates(c: Column, last: bool = True) -> Column:
    """Array of the block's JSON texts in order, those that parse to an object with a name."""
    found = F.regexp_extract_all(candidate_block(c, last), F.lit(r"(?s)<\|psep\|>(\{.*?\})<\|psep\|>"), 1)
    return F.filter(found, lambda x: F.coalesce(F.get_json_object(x, "$.user_name"), F.lit("")) != "")


def candidate_depth(c: Column) -> Column:
    """``depth`` of the first candidate of the first block."""
    return F.get_json_object(F.regexp_extract(candidate_block(c, last=False), r"(?s)<\|psep\|>(\{.*?\})<\|psep\|>", 1), "$.depth").try_cast("int")


def target_layer(c: Column) -> Column:
    return F.regexp_extract(c, r"<TL(\d+)>\s*$", 1).try_cast("int")


def render_candidates(names: Column, interests: Column, depth: Column) -> Column:
    """The block of candidates as compact JSON, one depth for all."""
    cells = F.zip_with(names, interests, lambda n, i: F.concat(F.lit(PSEP), F.to_json(F.struct(n.alias("user_name"), i.alias("interests"), depth.alias("depth"))), F.lit(PSEP)))
    return F.concat(F.lit(SPANS_START), F.array_join(cells, ""), F.lit(SPANS_END))


def json_list(texts: Column) -> Column:
    """A JSON array of texts with a blank after each comma."""
    cell = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(texts, cell), ", "), F.lit("]"))


def user_prompt(user: Column, content: Column, interests: Column, ancestors: Column, block: Column, layer: Column) -> Column:
    """The prompt of a node: its five lines, the block of candidates and the layer asked for at the end."""
    said = strip_repost_tail(F.coalesce(content, F.lit("")))
    return F.concat(
        F.lit("username: "), F.coalesce(user, F.lit("")), F.lit("\ncontent:\n"), said, F.lit("\nuserinterest: "), json_list(interests), F.lit("\nhistoricalinteractors: "), json_list(ancestors),
        F.lit("\npotentialspan:"), block, F.format_string("<TL%d>", layer))


def strip_candidate_block(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<POTENTIAL_SPANS>.*?</POTENTIAL_SPANS>", "")


def bump_candidates(c: Column, by: int) -> Column:
    """The text with the depths of its block's candidates raised, none below 0; other parts and texts without a block stay."""
    cell = "user_name string, interests array<string>, depth int"
    raised = lambda x: F.struct(x.user_name.alias("user_name"), x.interests.alias("interests"), F.greatest(x.depth + by, F.lit(0)).alias("depth"))
    cells = F.transform(candidates(c, last=False), lambda x: F.concat(F.lit(PSEP), F.to_json(raised(F.from_json(x, cell))), F.lit(PSEP)))
    head = F.substring_index(c, SPANS_START, 1)
    tail = _after(c, F.locate(SPANS_END, c) + len(SPANS_END) - 1)
    return F.when(c.contains(SPANS_START) & c.contains(SPANS_END), F.concat(head, F.lit(SPANS_START), F.array_join(cells, ""), F.lit(SPANS_END), tail)).otherwise(c)


def render_messages(messages: Column) -> Column:
    """``ROLE:`` line and content of each message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(F.coalesce(m.role, F.lit(""))), F.lit(":\n"), F.coalesce(m.content, F.lit("")), F.lit("\n"))), "")


def nature(c: Column) -> Column:
    """Repost, comment or original post by the text."""
    return F.when(c.isin(REPOST, REPOST_LONG), REPOST).when(c.contains("//@"), COMMENT).otherwise("原创博文")


def is_image_comment(c: Column) -> Column:
    return clean_strip(c).startswith(IMAGE_COMMENT)


def reaction(kind: Column, content: Column) -> Column:
    """2 for a repost or a comment that carries a repost chain, else 1."""
    return F.when((kind == REPOST_LONG) | content.contains("//@"), 2).otherwise(1)


def no_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*(?=[\]}])", "")


def array_slice(c: Column) -> Column:
    """From the first ``[`` to the last ``]``; null without both."""
    found = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def wrap_as_list(c: Column) -> Column:
    """Objects without any bracket put into brackets."""
    t = clean_strip(c)
    return F.when(~t.contains("[") & ~t.contains("]") & t.contains("{") & t.contains("}"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)


def guarded_json(c: Column) -> Column:
    """The text where it begins and ends like JSON and parses, else null (the parser alone allows text after a value)."""
    return F.when(c.rlike(r"^\s*[\[{]") & c.rlike(r"[\]}]\s*$") & F.try_parse_json(c).isNotNull(), c)


def split_names(c: Column) -> Column:
    """Names split at the first kind of separator that occurs."""
    out = F.array(clean_strip(c))
    for s in reversed(SEPARATORS):
        out = F.when(c.contains(s), F.filter(F.transform(F.split(c, F.lit("\\Q" + s + "\\E")), clean_strip), lambda x: x != "")).otherwise(out)
    return out


def prompt_hash(system: Column, user: Column) -> Column:
    """Identity of a prompt."""
    return F.sha2(F.concat(F.coalesce(system, F.lit("")), F.lit("\x00"), F.coalesce(user, F.lit(""))), 256)
