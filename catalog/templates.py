"""Template mining, matching, merging and the detection agent."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.patterns import WILDCARD
from timberline.functions.text import template_to_regex, tokenize_line
from timberline.operators import mining as M
from timberline.operators.verdicts import feedback_lookup, parse_verdict
from timberline.plans import detector as D
from timberline.session import materialize, passing, release

from . import inputs as I
from .counts import FIT, ONLINE_KEYS, RUNNING, online_keys, sql_paths, sql_score
from .registry import query
from .text import SQL_PAIR, SQL_REGEX

# every word of at most three letters but the first becomes the wildcard
_BLANKED = "list_transform(tokens, lambda x, i: case when i > 1 and length(x) < 4 then '<*>' else x end)"


def split_tokens(spark, sf):
    lines = I.split_lines(spark, sf)
    return materialize(
        lines.select("session_id", "line_id", "label", "level", "split", tokenize_line("content").alias("tokens")),
        "tokens",
    )


def _blanked(tokens):
    return F.transform(
        tokens, lambda x, i: F.when((i > 0) & (F.length(x) < 4), WILDCARD).otherwise(x)
    )


SQL_TEMPLATES = f"""templates as (
  select level, tokens[1] head, b tokens, min(line_id) template_id, {SQL_REGEX.format('b')} regex
  from (select *, {_BLANKED} b from tokens where split = 'train') group by level, head, b)"""


def blanked_templates(tokens):
    """Distinct blanked token lists of the train lines; a leaf is (language, first token)."""
    return (
        tokens.filter("split = 'train'")
        .groupBy(
            F.col("level").alias("group_key"), F.slice("tokens", 1, 1).alias("path"),
            _blanked("tokens").alias("tokens"),
        )
        .agg(F.min("line_id").alias("template_id"))
        .withColumn("created_seq", F.col("template_id"))
        .withColumn("regex", template_to_regex("tokens"))
    )


@query(
    "match_templates",
    f"""with {I.TOKENS}, {SQL_TEMPLATES}, pairs as (
      select l.line_id, t.template_id, case when regexp_matches(array_to_string(l.tokens, ' '), t.regex) then 1.0::double
        else length(list_intersect(l.tokens, t.tokens))::double / nullif(length(list_distinct(list_concat(l.tokens, t.tokens))), 0) end sim
      from tokens l join templates t on l.level = t.level and l.tokens[1] is not distinct from t.head
      where l.split = 'test')
    select line_id, template_id, round(sim, 6) sim from (
      select *, row_number() over (partition by line_id order by sim desc, template_id desc) r from pairs)
    where r = 1 and sim >= 0.5""",
)
def match_templates(spark, sf):
    with passing(spark):
        tokens = split_tokens(spark, sf)
        test = materialize(tokens.filter("split = 'test'").select(
            "line_id", F.col("level").alias("group_key"), F.slice("tokens", 1, 1).alias("path"), "tokens"
        ), "test")
        templates = materialize(blanked_templates(tokens).drop("regex"), "blanked")
        release(tokens)
        out = M.match_templates(test, templates, 0.5)
        return materialize(out.select("line_id", "template_id", F.round("sim", 6).alias("sim")), "matches", stay=True)


# the last word becomes the wildcard
_OPEN_END = "list_transform(tokens, lambda x, i: case when i > 1 and i = length(tokens) then '<*>' else x end)"
_ENDED = f"""templates as (
  select b tokens, min(line_id) template_id, {SQL_REGEX.format('b')} regex
  from (select *, {_OPEN_END} b from tokens where split = 'train') group by b)"""


@query(
    "feedback_lookup",
    f"""with {I.TOKENS}, {_ENDED},
    stored as (select array_to_string(tokens, ' ') template, min(line_id) seq, arg_max(label, line_id) score
      from tokens where split = 'test' group by tokens),
    asked as (select template_id, array_to_string(tokens, ' ') template, regex,
      split_part(array_to_string(tokens, ' '), '<*>', 1) prefix from templates),
    one as (select template_id, score from asked join stored using (template)),
    two as (select a.template_id, arg_max(s.score, s.seq) score from asked a join stored s
      on case when starts_with(s.template, a.prefix) then regexp_matches(s.template, a.regex) else false end
      where a.template_id not in (select template_id from one) group by a.template_id)
    select template_id, coalesce(one.score, two.score) score,
      case when one.score is not null then 1 when two.score is not null then 2 end as level
    from asked left join one using (template_id) left join two using (template_id)""",
)
def feedback(spark, sf):
    tokens = split_tokens(spark, sf)
    stored = tokens.filter("split = 'test'").select(
        F.array_join("tokens", " ").alias("template"), F.col("label").alias("score"), F.col("line_id").alias("seq")
    )
    ended = F.transform(
        "tokens", lambda x, i: F.when((i > 0) & (i == F.size("tokens") - 1), WILDCARD).otherwise(x)
    )
    templates = (
        tokens.filter("split = 'train'").groupBy(ended.alias("tokens"))
        .agg(F.min("line_id").alias("template_id"))
    )
    return feedback_lookup(templates, stored)


@query(
    "generalize_template",
    f"""with {I.TOKENS} select session_id, array_to_string(list_reduce(list(tokens order by line_id),
    lambda a, b: {SQL_PAIR.format(a='a', b='b')}), ' ') template from tokens group by session_id""",
)
def generalize_template(spark, sf):
    out = M.generalize_template(split_tokens(spark, sf), "session_id")
    return out.select("session_id", F.array_join("tokens", " ").alias("template"))


@query(
    "cluster_sizes",
    f"with {I.EVENTS} select session_id, count(*) size from event_lines group by session_id",
)
def cluster_sizes(spark, sf):
    return M.cluster_sizes(I.event_lines(spark, sf), "session_id")


@query(
    "cluster_label",
    f"with {I.EVENTS} select session_id, arg_max(label, line_id) label from event_lines group by session_id",
)
def cluster_label(spark, sf):
    return M.cluster_label(I.event_lines(spark, sf), "session_id")


@query(
    "attach_templates",
    f"""with {I.TOKENS}, ids as (select line_id, min(line_id) over (partition by level, tokens[1]) template_id,
      level || '-' || coalesce(tokens[1], '') name from tokens where split = 'train')
    select t.line_id, ids.name event_template from tokens t left join ids using (line_id)""",
)
def attach_templates(spark, sf):
    """Lines of the test split have no cluster and stay without a template."""
    tokens = split_tokens(spark, sf)
    head = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    keyed = tokens.filter("split = 'train'").select("line_id", F.concat_ws("-", "level", head).alias("template"))
    templates = keyed.groupBy("template").agg(F.min("line_id").alias("template_id"))
    assignments = keyed.join(templates, "template").select("line_id", "template_id")
    return M.attach_templates(tokens, assignments, templates).select("line_id", "event_template")


# ---------------------------------------------------------------- mined templates

# line by line: the n-th lines of all leaves meet the templates that the lines before them left. A row is a
# template (kind 0), an assignment with the template of the moment (1) or the number of lines done (2)
_REGEX_NOW, _PAIR_NOW = SQL_REGEX.format("t.toks"), SQL_PAIR.format(a="toks", b="seq")
MINED = f"""placed as materialized (
    select line_id, leaf, seq, row_number() over (partition by leaf order by line_id) n from (
      select line_id, g || chr(10) || path leaf, list_concat(string_split(path, ' ')[2:], tokens[5:]) seq from p4 where len(tokens) > 0)),
  mined(kind, id, leaf, template_id, toks) using key (kind, id) as (
    select 2, 0::bigint, null::varchar, 0::bigint, null::varchar[]
    union
    select * from (
      with now as (select p.* from placed p join mined c on c.kind = 2 and p.n = c.template_id + 1),
      sims as (select l.line_id, l.leaf, l.seq, t.id tid, t.toks, case when regexp_matches(array_to_string(l.seq, ' '), {_REGEX_NOW}) then 1.0::double
          else length(list_intersect(l.seq, t.toks))::double / length(list_distinct(list_concat(l.seq, t.toks))) end sim
        from now l left join recurring.mined t on t.kind = 0 and t.leaf = l.leaf),
      best as (select line_id, any_value(leaf) leaf, any_value(seq) seq, max(sim) sim, arg_max(tid, (sim, tid)) tid, arg_max(toks, (sim, tid)) toks
        from sims group by line_id),
      done as (select line_id, leaf, case when sim >= 0.5 then tid else line_id end tid, case when sim >= 0.5 then {_PAIR_NOW} else seq end toks from best)
      select 0, tid, leaf, tid, toks from done
      union all select 1, line_id, leaf, tid, toks from done
      union all select 2, 0, null, c.template_id + 1, null from mined c where c.kind = 2 and exists (select 1 from now))),
  assigned as (
    select id line_id, template_id, toks from mined where kind = 1
    union all select line_id, min(line_id) over (partition by g), [] from p4 where len(tokens) = 0)"""



def _snapshots(lines: str, then: str) -> str:
    """``then`` over ``tokens``: the lines chosen by ``lines``, each with its template of the moment as tokens."""
    return f"""with {I.TOKENS}, chosen as ({lines}) select * from (
    with recursive tokens as (select * from chosen), {online_keys('')}, {sql_paths(4, 2, 'group_key')}, {MINED},
    shots as materialized (select t.line_id, t.label, t.split, a.toks from assigned a join tokens t using (line_id))
    select * from (with tokens as (select line_id, label, split, toks tokens from shots), {then}))"""


# the train lines, then the first test line of each template
_JUDGED = """select * from tokens where split = 'train' union all select * exclude (r) from (
  select *, row_number() over (partition by event_template order by line_id) r from tokens where split = 'test') where r = 1"""
_TESTED = "test as (select line_id, label, tokens from tokens where split = 'test')"
_VERDICTS = "select line_id, label, prediction, round(score_0, 5) score_0 from scored"

@query(
    "mine_templates",
    f"""with recursive {I.TOKENS}, {ONLINE_KEYS}, {sql_paths(4, 2, 'group_key')}, {MINED},
    sizes as (select template_id, count(*)::bigint size, arg_max(label, line_id) label from assigned join tokens using (line_id) group by template_id),
    found as (select id template_id, split_part(leaf, chr(10), 1) group_key, toks from mined where kind = 0
      union all select min(line_id), g, [] from p4 where len(tokens) = 0 group by g)
    select template_id, group_key, array_to_string(toks, ' ') template, {SQL_REGEX.format('toks')} regex, size, label
    from found join sizes using (template_id)""",
)
def mine_templates(spark, sf):
    mined = M.mine_templates(I.lines(spark, sf), heads=["level"])
    return mined.templates.select("template_id", "group_key", "template", "regex", "size", "label")


@query(
    "mine_assignments",
    f"""with recursive {I.TOKENS}, {ONLINE_KEYS}, {sql_paths(4, 2, 'group_key')}, {MINED}
    select line_id, label, template_id, array_to_string(toks, ' ') snapshot from assigned join tokens using (line_id)""",
)
def mine_assignments(spark, sf):
    """Every line with its template and what that looked like when the line had joined it."""
    mined = M.mine_templates(I.lines(spark, sf), heads=["level"])
    return mined.assignments.select("line_id", "label", "template_id", F.array_join("snapshot", " ").alias("snapshot"))


# claims settled in rounds: of those without an owner the ones whose first match is an owner, or that have none
_CLAIMS = f"""with recursive {I.TOKENS}, {SQL_TEMPLATES},
    ranked as materialized (select template_id, level, head, regex, array_to_string(tokens, ' ') txt,
      row_number() over (order by -len(list_filter(tokens, lambda t: t = '<*>')), -len(tokens), template_id) r from templates),
    -- patterns here begin with a word, so a match has the same one
    pairs as materialized (select p.template_id p, t.template_id t, p.r r from ranked p join ranked t
      on p.level = t.level and p.head is not distinct from t.head and p.r < t.r where regexp_matches(t.txt, p.regex)),
    claims(template_id, claimant_id) using key (template_id) as (
      select template_id, null::bigint from ranked
      union
      select c.template_id, coalesce(f.p, c.template_id) from recurring.claims c
      left join (
        select q.t, arg_min(q.p, q.r) p, arg_min(coalesce(s.claimant_id, -1), q.r) owner from pairs q
        join recurring.claims s on s.template_id = q.p where s.claimant_id is null or s.claimant_id = s.template_id group by q.t) f
        on f.t = c.template_id
      where c.claimant_id is null and (f.t is null or f.owner >= 0))"""


@query("subsume_templates", f"{_CLAIMS} select template_id, claimant_id from claims")
def subsume_templates(spark, sf):
    with passing(spark):
        templates = blanked_templates(split_tokens(spark, sf)).select("template_id", "group_key", "tokens")
        return materialize(M.subsume_templates(templates), "claims", stay=True)


@query(
    "apply_template_delta",
    f"""{_CLAIMS}, merged as (select claimant_id template_id, count(*) size from claims group by claimant_id having count(*) > 1)
    select r.template_id, r.level group_key, r.txt as template, 1::int size from ranked r join claims c using (template_id)
      where c.claimant_id not in (select template_id from merged)
    union all
    select (select max(template_id) from ranked) + row_number() over (order by m.template_id), r.level, r.txt, m.size::int
      from merged m join ranked r using (template_id)""",
)
def apply_template_delta(spark, sf):
    with passing(spark):
        templates = blanked_templates(split_tokens(spark, sf)).select("template_id", "group_key", "tokens")
        templates = materialize(templates.withColumn("size", F.lit(1)), "templates", stay=True)
    claims = M.subsume_templates(templates)
    absorbed = claims.groupBy("claimant_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    changed = claims.join(absorbed, "claimant_id", "left_semi").select("template_id")
    merged = M.merge_templates(templates, claims)
    out, _ = M.apply_template_delta(
        templates, changed, merged.filter("n_merged > 1").drop("n_merged").select(*templates.columns)
    )
    return out.select("template_id", "group_key", F.array_join("tokens", " ").alias("template"), "size")


@query("reinsert_templates")
def reinsert_templates(spark, sf):
    """The templates of every group in which one absorbed another, after they went through a new tree."""
    with passing(spark):
        templates = blanked_templates(split_tokens(spark, sf)).select("template_id", "group_key", "tokens")
        templates = materialize(
            templates.withColumns({"size": F.lit(1).cast("long"), "label": F.lit(0)}), "templates", stay=True)
    claims = M.subsume_templates(templates)
    _, found, _, _ = M.reinsert_templates(templates, claims)
    return found.select("template_id", "group_key", F.array_join("tokens", " ").alias("template"), "size")


@query("fit_detector", _snapshots("select * from tokens where split = 'train'", f"{FIT} select ngram, label, n from ngram_counts"))
def fit_detector(spark, sf):
    detector, metrics = D.fit_detector(I.split_lines(spark, sf).filter("split = 'train'"))
    return detector.counts.ngram_counts


@query("apply_feedback")
def apply_feedback(spark, sf):
    detector, _ = D.fit_detector(I.split_lines(spark, sf).filter("split = 'train'"))
    verdicts = parse_verdict(I.raw_verdicts(spark, sf))[0]
    return D.apply_feedback(detector, verdicts).counts.class_counts.select("label", "n")


@query("detect_lines", _snapshots(_JUDGED, f"{FIT}, {_TESTED}, {sql_score('test')} {_VERDICTS}"))
def detect_lines(spark, sf):
    lines = I.split_lines(spark, sf)
    detector, _ = D.fit_detector(lines.filter("split = 'train'"))
    predictions, _ = D.detect_lines(lines.filter("split = 'test'"), detector)
    return predictions.select("line_id", "label", "prediction", F.round("score_0", 5).alias("score_0"))


@query("detect_lines_frozen")
def detect_lines_frozen(spark, sf):
    lines = I.split_lines(spark, sf)
    detector, _ = D.fit_detector(lines.filter("split = 'train'"))
    predictions, _ = D.detect_lines(lines.filter("split = 'test'"), detector, online=False)
    return predictions.select("line_id", "label", "prediction", F.round("score_0", 5).alias("score_0"))


@query("detect_lines_update", _snapshots(_JUDGED, f"{FIT}, {_TESTED}, {RUNNING} {_VERDICTS}"))
def detect_lines_update(spark, sf):
    lines = I.split_lines(spark, sf)
    detector, _ = D.fit_detector(lines.filter("split = 'train'"))
    predictions, _ = D.detect_lines(lines.filter("split = 'test'"), detector, update=True)
    return predictions.select("line_id", "label", "prediction", F.round("score_0", 5).alias("score_0"))
