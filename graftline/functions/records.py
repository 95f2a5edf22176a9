"""Reading of samples, steps and gold records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.lenient import NOTHING, names
from graftline.functions.text import candidates, guarded_json, interact_header, render_candidates, split_names, strip_candidate_block
from graftline.runtime import clean_strip

ROOT = "__ROOT__"
#: Keys under which a list of items may be wrapped; fixed values.
WRAPPERS = ("items", "output", "candidates", "data", "list", "arr")
#: Keys that hold the truth and must not reach a model; fixed values.
PRIVATE = ("gt_by_turn", "gt", "gold", "labels", "answer", "evaluation", "rewards", "reward_model", "depth")
MESSAGE = "array<struct<role:string,content:string,depth:int>>"


def public_fields(c: Column, private: tuple[str, ...] = PRIVATE) -> Column:
    """A JSON object as a map without private keys and those that begin with ``_``."""
    return F.map_filter(F.from_json(c, "map<string,string>"), lambda k, _: ~k.startswith("_") & ~k.isin(*private))


def has_field(schema: T.StructType, column: str, field: str) -> bool:
    """Whether an array of structs, or a struct, has the field."""
    kind = schema[column].dataType if column in schema.names else None
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return isinstance(kind, T.StructType) and field in kind.names


def is_parse_fail(status: Column) -> Column:
    return F.coalesce(status.startswith("parse_fail"), F.lit(False))


def kept_order(children: Column, pool: Column) -> Column:
    """The children that are in the pool, each once, in their order."""
    return F.array_intersect(children, pool)


def quoted_list(c: Column) -> Column:
    """A JSON array of texts; where it does not parse, whatever stands in double quotes."""
    strict = F.when(c.rlike(r"^\s*\[") & F.try_parse_json(c).isNotNull(), F.from_json(c, "array<string>"))
    return F.coalesce(strict, F.regexp_extract_all(c, F.lit(r'"([^"]*)"'), 1))


def glob_pattern(glob: str) -> str:
    """A file pattern with ``*`` as a regular expression over whole names."""
    return "^" + re.escape(glob).replace(r"\*", ".*") + "$"


def unwrapped_items(c: Column) -> Column:
    """JSON text of an item list: the array itself or the first wrapper key that holds one."""
    direct = F.when(c.rlike(r"^\s*\["), c)
    return F.coalesce(direct, *[F.when(F.get_json_object(c, f"$.{k}").rlike(r"^\s*\["), F.get_json_object(c, f"$.{k}")) for k in WRAPPERS])


def positive_children(items: Column, order: Column) -> Column:
    """Names of items of type 1 or 2; by the candidates' order where a name is missing or the lengths differ."""
    positive = lambda t: t.isin(1, 2)
    named = F.size(items) == F.size(order)
    complete = named & F.forall(items, lambda x: F.coalesce(x.user_name, F.lit("")) != "")
    by_name = F.transform(F.filter(items, lambda x: positive(x.type)), lambda x: x.user_name)
    n = F.least(F.size(items), F.size(order))
    pairs = F.arrays_zip(F.transform(F.slice(items, F.lit(1), n), lambda x: x.type).alias("t"), F.slice(order, F.lit(1), n).alias("u"))
    by_place = F.transform(F.filter(pairs, lambda p: positive(p.t)), lambda p: p.u)
    return F.when(complete, by_name).otherwise(by_place)


def candidate_names(c: Column) -> Column:
    return F.transform(candidates(c), lambda x: F.get_json_object(x, "$.user_name"))


def message_depth(depth: Column, content: Column) -> Column:
    """The message's own depth, that in its content, or the number of earlier interactors."""
    return F.coalesce(depth, F.get_json_object(content, "$.depth").try_cast("int"), F.json_array_length(F.get_json_object(content, "$.historical_interactors")))


def reward(*places: Column) -> Column:
    """The first number among rewards, trajectory_reward and step_reward of the places, else 0."""
    keys = ("rewards", "trajectory_reward", "step_reward")
    return F.coalesce(*[F.get_json_object(p, f"$.{k}").try_cast("double") for p in places for k in keys], F.lit(0.0))


#: Names under which the truth by depth stands; fixed values.
TRUTH = ("cond_gt_by_turn", "cond_gold_by_turn")
LAYERS = "array<array<map<string,array<string>>>>"


def _first_array(c: Column, paths: list[str]) -> Column:
    """JSON text of the first of the paths that holds an array."""
    found = [F.get_json_object(c, p) for p in paths]
    return F.coalesce(*[F.when(x.rlike(r"^\s*\["), x) for x in found])


def truth_of_prompts(c: Column) -> Column:
    """The truth by depth in the JSON of a batch's prompts, wherever it stands; an empty array where it does not."""
    models = ("reward_model", "reward_models[0]", "meta_info.reward_model")
    paths = [f"$.{m}.{gt}.{k}" for m in models[:2] for gt in ("ground_truth", "gt") for k in TRUTH] + [f"$.ground_truth.{k}" for k in TRUTH] + [f"$.{k}" for k in TRUTH]
    return F.coalesce(_first_array(c, paths + [f"$.{models[2]}.{gt}.{k}" for gt in ("ground_truth", "gt") for k in TRUTH]), F.lit("[]"))


def first_user(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m.role == "user"), 0).content


def root_user(messages: Column) -> Column:
    """The first user message's content where it is a JSON object, else null."""
    c = first_user(messages)
    return F.when(c.rlike(r"^\s*\{") & F.try_parse_json(c).isNotNull(), c)


def truth_of_record(messages: Column) -> Column:
    """Layers of {parent: children} in the first user message; empty without them."""
    c = _first_array(root_user(messages), ["$.reward_model.ground_truth.cond_gt_by_turn"])
    return F.coalesce(F.from_json(c, LAYERS), F.from_json(F.lit("[]"), LAYERS))


def truth_by_turn(reward_model: Column) -> Column:
    """JSON text of ``gt_by_turn`` in a reward model's JSON, null without it."""
    return _first_array(reward_model, ["$.ground_truth.gt_by_turn"])


_POT = "array<struct<user_name:string,interests:array<string>>>"


def root_pool(user: Column) -> Column:
    """Candidates (user_name, interests) in a root user's JSON: the full ones, else the names with no interests; blanks dropped."""
    full = F.from_json(F.get_json_object(user, "$.reward_model.root_potential.full"), _POT)
    names_ = F.from_json(F.get_json_object(user, "$.reward_model.root_potential.user_names"), "array<string>")
    none = F.array().cast("array<string>")
    shaped = lambda n, i: F.struct(F.trim(n).alias("user_name"), F.coalesce(i, none).alias("interests"))
    pool = F.when(F.size(full) > 0, F.transform(full, lambda x: shaped(x.user_name, x.interests))).otherwise(F.transform(names_, lambda n: shaped(n, none)))
    return F.filter(F.coalesce(pool, F.array().cast(_POT)), lambda x: F.coalesce(x.user_name, F.lit("")) != "")


def interests_in_pool(user: Column, name: Column) -> Column:
    """Interests of the first candidate with the name; empty without one."""
    return F.coalesce(F.get(F.filter(root_pool(user), lambda x: x.user_name == F.trim(name)), 0).interests, F.array().cast("array<string>"))


def rebuilt_view(user: Column, depth: Column) -> Column:
    """The content that a model sees at a depth: without the old block of candidates, with that of the root's pool."""
    pool, content = root_pool(user), F.coalesce(F.get_json_object(user, "$.content"), F.lit(""))
    block = render_candidates(F.transform(pool, lambda x: x.user_name), F.transform(pool, lambda x: x.interests), depth)
    return F.when(F.size(pool) > 0, F.concat(F.rtrim(strip_candidate_block(content)), block)).otherwise(content)


def has_pred(output: Column) -> Column:
    """Whether an output predicts anyone: no header of 0, and a JSON array that is not empty."""
    body = interact_header(output)
    n = F.when(guarded_json(body.body).rlike(r"^\s*\["), F.json_array_length(body.body))
    return F.coalesce((F.coalesce(body.tag, F.lit(1)) != 0) & (n > 0), F.lit(False))


def output_items(output: Column) -> Column:
    """Struct of a logged output's objects, as JSON texts, and whether it could not be read as a list."""
    head = interact_header(output)
    silent = (F.coalesce(head.tag, F.lit(-1)) == 0) | F.coalesce(head.body.isin("[]", NOTHING) | (head.body == "") & head.tag.isNotNull(), F.lit(False))
    read = F.when(guarded_json(head.body).rlike(r"^\s*\["), F.from_json(head.body, "array<string>"))
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(F.when(~silent, F.filter(read, lambda x: x.startswith("{"))), none).alias("items"), (~silent & read.isNull()).alias("failed"))


def old_children(output: Column) -> Column:
    """Names in an answer of the oldest form: under a header or not, a JSON array, one object or separated names."""
    t = clean_strip(output)
    headed = t.startswith("[INTERACT=")
    body = F.when(headed, F.when(t.contains("\n"), clean_strip(F.substring(t, F.locate("\n", t) + 1, F.length(t)))).otherwise("")).otherwise(t)
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.user_name")).otherwise(x)
    listed = F.transform(F.from_json(body, "array<string>"), lambda x: clean_strip(name(x)))
    kept = lambda a: F.filter(F.array_distinct(a), lambda x: F.coalesce(x, F.lit("")) != "")
    silent = (body == "") | body.isin("[]", NOTHING)
    return F.when(silent, F.array().cast("array<string>")).when(guarded_json(body).rlike(r"^\s*\["), kept(listed)).when(
        guarded_json(body).isNotNull(), kept(F.array(clean_strip(F.get_json_object(body, "$.user_name"))))).otherwise(split_names(body))


def chunk_info(info: Column, sample_id: Column, meta: Column) -> Column:
    """Where a sample comes from: a meta message's JSON first, then the column's, then the id."""
    m = F.from_json(meta, "record_id string, root_user string, chunk_index int, chunk_size int, first_layer_users array<string>")
    c = F.from_json(info, "record_id string, root_user string, potential_chunk_index int, k_per_chunk int")
    return F.struct(
        sample_id.alias("sample_id"), F.coalesce(m.record_id, c.record_id, F.nullif(F.regexp_extract(sample_id, "^(.*?)_node_", 1), F.lit(""))).alias("record_id"), F.coalesce(m.root_user, c.root_user).alias("root_user"),
        F.coalesce(m.chunk_index, c.potential_chunk_index, F.regexp_extract(sample_id, r"_potchunk_(\d+)", 1).try_cast("int")).alias("chunk_index"), F.coalesce(m.chunk_size, c.k_per_chunk).alias("chunk_size"),
        m.first_layer_users.alias("first_layer_users"))


def system_content(messages: Column) -> Column:
    """The first system message, out of the quotes that it may be kept in as a JSON text."""
    c = F.coalesce(F.get(F.filter(messages, lambda m: m.role == "system"), 0).content, F.lit(""))
    quoted = F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), 0)
    return F.when(c.rlike(r'^\s*"') & F.try_parse_json(c).isNotNull(), quoted).otherwise(c)


def is_parent_maps(c: Column) -> Column:
    """Whether a JSON array holds only objects of one key each with a list; an empty one does."""
    maps = F.from_json(c, "array<map<string,array<string>>>")
    return F.coalesce(c.rlike(r"^\s*\[") & F.forall(maps, lambda m: F.size(m) == 1), F.lit(False))


def children_names(c: Column) -> Column:
    """Names in a level given as parent maps, as one object of lists, or as a list."""
    def run(texts: pd.Series) -> pd.Series:
        import json

        out = []
        for t in texts:
            try:
                v = json.loads(t) if isinstance(t, str) else None
            except ValueError:
                v = None
            if isinstance(v, dict):
                v = list(v.values())
            elif isinstance(v, list) and v and all(isinstance(x, dict) and len(x) == 1 and isinstance(next(iter(x.values())), list) for x in v):
                v = [y for x in v for y in x.values()]
            out.append(names(v or []))
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.StringType()))(c)


def sample_origin(info: Column, sample_id: Column) -> Column:
    """record_id, root_user and chunk of a sample: from its JSON, else from its id."""
    parsed = F.from_json(info, "record_id string, root_user string, potential_chunk_index int, k_per_chunk int")
    return F.struct(
        F.coalesce(parsed.record_id, F.regexp_extract(sample_id, "^(.*?)_node_", 1)).alias("record_id"), parsed.root_user.alias("root_user"),
        F.coalesce(parsed.potential_chunk_index, F.regexp_extract(sample_id, r"_potchunk_(\d+)", 1).try_cast("int")).alias("chunk"))


def by_name_or_place(names_: Column, said: Column, name: Column, place: Column) -> Column:
    """The comment of the item with the name, the last of several; else of the item at the place; blank ones count as none."""
    pairs = F.arrays_zip(names_.alias("n"), said.alias("s"))
    mine = F.filter(pairs, lambda p: (p.n == name) & (F.coalesce(p.s, F.lit("")) != ""))
    at = F.get(said, place)
    return F.coalesce(F.element_at(mine, F.when(F.size(mine) > 0, -1)).s, F.when(at != "", at))
