"""Queries of service schedules over whole tables (survey T15, T16). Their SQL groups where the operators use windows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waymark.operators import schedules
from waymark.queries.registry import FIXTURES, SQL_ONLY, Tables, query

#: Layouts of a schedule; a row's own day, hour, minute, language and activity stand in for #D, #H, #M, #L and #A.
_LAYOUTS = [
    "#D #H:#M AM #L #A", "#D #A: #L: #H:#M a.m.- 1:00 p.m. – 7:00 p.m. English: 9:30 a.m.", "#L / #Ds / #H:#M PM /// SPANISH / Sundays / 9:00 AM", "#H:#M AM #L #A 09:30 AM Sung #A 11:30 AM Latin",
    "#D #H–#H:45am #A (#L); Friday 7p youth", "주일 오전 #H시 예배", "主日上午 #H:#M 崇拜（粵語）；週三晚上七時半 查經", "#A at #H:#M pm #D 4pm #L (Vigil) Sunday 8am", "#L #As: #D #H:#M AM, #H PM, 12:00 PM",
    "#D: #H:#M AM, 4:00 PM (#L), and 7:00 PM", "by appointment", None, "domingo #H p.m. en #L. #D 10am to 11am to 12pm #A", "#D #A #H:#Mam - #H:#Mpm #L #A; #Hpm", "", "#D #H:#Mam #A (#L) 11am English #A 1pm", "#H-11am #D #L; #H to 9:30p #A",
]
_WORDS = {"#D": ["Sunday", "sat", "Wednesday", "Fri", "monday", "Dom", "週二"], "#L": ["Spanish", "Korean", "Mandarin", "tiếng Việt", "Latin"], "#A": ["Mass", "worship", "Bible Study", "Sunday School"]}


def _chosen(key: str, values: list[str | None]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


def _filled(layout: str, shift: int) -> str:
    out = f"replace(replace({layout}, '#H', CAST(1 + (c_custkey + {shift}) % 12 AS STRING)), '#M', CASE c_custkey % 4 WHEN 0 THEN '00' WHEN 1 THEN '15' WHEN 2 THEN '30' ELSE '05' END)"
    for k, (mark, values) in enumerate(_WORDS.items()):
        out = f"replace({out}, '{mark}', {_chosen(f'(c_custkey + {shift * k})', values)})"
    return out


FIXTURES["schedules"] = (
    f"SELECT c_custkey AS place_id, {_filled(_chosen('c_custkey', _LAYOUTS), 0)} AS schedule, CASE c_custkey % 5 WHEN 0 THEN upper({_filled(_chosen('c_custkey', _LAYOUTS), 0)}) WHEN 1 THEN 'Join us. ' || {_filled(_chosen('c_custkey', _LAYOUTS), 0)} || ' (all welcome)'"
    f" WHEN 2 THEN {_filled(_chosen('c_custkey', _LAYOUTS), 1)} ELSE {_filled(_chosen('(c_custkey * 3 + 1)', _LAYOUTS), 0)} END AS excerpt FROM {{customer}}"
)


def _text(pattern: str) -> str:
    return "'" + pattern.replace("{", "{{").replace("}", "}}") + "'"


def _part(pattern: str, group: int) -> str:
    return f"regexp_extract(token, {_text(f'^(?:{pattern})$')}, {group})"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _word_columns(g: str) -> str:
    return f"count({g}) AS {g}_n, count({g}) FILTER (seg = 0) AS {g}_lead, count({g}) FILTER (seg = times) AS {g}_trail, coalesce(bool_or(inside) FILTER ({g} IS NOT NULL), false) AS {g}_inside, arg_max({g}, i) FILTER ({g} IS NOT NULL) AS {g}_last"


def _follows(g: str) -> str:
    return f"CASE WHEN {g}_n = 0 THEN false WHEN ({g}_trail > 0) <> ({g}_lead > 0) THEN {g}_trail > 0 WHEN {g}_inside THEN true WHEN {g}_trail <> {g}_lead THEN {g}_trail > {g}_lead END AS {g}_follows"


def _reading(g: str) -> str:
    return f"CASE WHEN {g}_follows THEN [{g}_after] WHEN NOT {g}_follows THEN [{g}_front] WHEN k % 3 = 0 THEN [{g}_after, {g}_front] ELSE [CASE WHEN {g}_after = {g}_front THEN {g}_after END] END AS {g}_of"


#: k is three times the place and 0 for what the schedule claims, 1 for what the excerpt states, 2 for what the schedule states.
SQL_ONLY["schedule_slots"] = f"""
SELECT k, day, act, lang, printf('%02d:%02d', mins // 60, mins % 60) AS clock FROM (
WITH said AS (SELECT place_id * 3 AS k, schedule AS x FROM {{schedules}} UNION ALL SELECT place_id * 3 + 1, excerpt FROM {{schedules}} UNION ALL SELECT place_id * 3 + 2, schedule FROM {{schedules}}),
clauses AS (SELECT k, unnest(l) AS clause, generate_subscripts(l, 1) AS c FROM (SELECT k, string_split_regex(lower(translate(x, chr(12288) || chr(160), '  ')), {_text(schedules.CLAUSE_END)}) AS l FROM said)),
tokens AS (SELECT k, c, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT k, c, regexp_extract_all(regexp_replace(regexp_replace(clause, '([a-z]+)', '⟨\\1⟩', 'g'), '([0-9]+)', '‹\\1›', 'g'), {_text(schedules.TOKEN)}) AS l FROM clauses)),
meanings(token, day, act, lang) AS (VALUES {_values([(w, *m) for w, m in schedules.MEANINGS.items()])}),
hours(said, hour) AS (VALUES {_values(list(schedules.HOURS.items()))}),
numbers AS (SELECT k, c, i, token, TRY_CAST({_part(schedules.TIME, 5)} AS INT) AS h, coalesce(TRY_CAST({_part(schedules.TIME, 6)} AS INT), 0) AS m, {_part(schedules.TIME, 7)} = 'p' AS pm, TRY_CAST({_part(schedules.TIME, 2)} AS INT) AS h0, coalesce(TRY_CAST({_part(schedules.TIME, 3)} AS INT), 0) AS m0, {_part(schedules.TIME, 1)} AS led, {_part(schedules.TIME, 4)} <> '' AS linked,
  coalesce(TRY_CAST({_part(schedules.EASTERN_TIME, 2)} AS INT), hour) AS eh, coalesce(TRY_CAST({_part(schedules.EASTERN_TIME, 4)} AS INT), TRY_CAST({_part(schedules.EASTERN_TIME, 5)} AS INT), CASE WHEN {_part(schedules.EASTERN_TIME, 6)} <> '' THEN 30 ELSE 0 END) AS em, {_part(schedules.EASTERN_TIME, 1)} IN ({", ".join(f"'{w}'" for w in schedules.AFTERNOON)}) AS epm
  FROM tokens LEFT JOIN hours ON hours.said = {_part(schedules.EASTERN_TIME, 3)}),
clocks AS (SELECT *, (h % 12 + CASE WHEN pm THEN 12 ELSE 0 END) * 60 + m AS t, (h0 % 12 + CASE WHEN pm = (h0 % 12 * 60 + m0 <= h % 12 * 60 + m) THEN 12 ELSE 0 END) * 60 + m0 AS t0 FROM numbers),
opened AS (SELECT *, coalesce(h0 BETWEEN 1 AND 12 AND led = '' AND t - t0 BETWEEN 15 AND 180, false) AS opens FROM clocks),
begun AS (SELECT k, c, i, token, h IS NOT NULL AS plain, opens, linked, CASE WHEN h BETWEEN 1 AND 12 THEN CASE WHEN opens THEN t0 ELSE t END END AS west, CASE WHEN eh BETWEEN 1 AND 12 THEN (eh % 12 + CASE WHEN epm THEN 12 ELSE 0 END) * 60 + em END AS east FROM opened),
ended AS (SELECT b.*, coalesce(b.linked AND NOT p.opens AND b.west - p.west BETWEEN 15 AND 180, false) AS ends FROM begun b LEFT JOIN begun p ON p.k = b.k AND p.c = b.c AND p.i = b.i - 1),
times AS (SELECT *, coalesce(CASE WHEN NOT ends OR (i - coalesce(max(i) FILTER (NOT ends) OVER (PARTITION BY k, c ORDER BY i), 0)) % 2 = 0 THEN west END, east) AS mins FROM ended),
told AS (SELECT times.*, day, act, lang, count(mins) OVER (PARTITION BY k, c) AS times, count(mins) OVER (PARTITION BY k, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg,
  mins IS NOT NULL AND NOT plain OR mins IS NULL AND NOT plain AND regexp_matches(token, '\\pL') AND token NOT IN ({", ".join(f"'⟨{w}⟩'" for w in schedules.BARE_WORDS)}) AS wordy FROM times LEFT JOIN meanings USING (token)),
placed AS (SELECT *, last_value(CASE token WHEN '(' THEN true WHEN ')' THEN false END IGNORE NULLS) OVER (PARTITION BY k, c, seg ORDER BY i) AS inside FROM told),
heads AS (SELECT k, c, any_value(times) AS times, bool_or(wordy) AS wordy, arg_max(day, i) FILTER (day IS NOT NULL) AS day_last, {_word_columns("act")}, {_word_columns("lang")} FROM placed GROUP BY k, c),
modes AS (SELECT *, times > 0 AND NOT wordy AND act_n + lang_n = 0 AS bare, {_follows("act")}, {_follows("lang")} FROM heads),
segs AS (SELECT k, c, seg, {", ".join(f"arg_min({g}, i) FILTER ({g} IS NOT NULL) AS {g}_first, arg_max({g}, i) FILTER ({g} IS NOT NULL) AS {g}_seg" for g in ("act", "lang"))} FROM placed GROUP BY k, c, seg),
runs AS (SELECT *, {", ".join(f"last_value({g}_seg IGNORE NULLS) OVER (PARTITION BY k, c ORDER BY seg) AS {g}_run" for g in ("act", "lang"))} FROM segs),
fronts AS (SELECT p.k, p.c, p.i, p.seg, p.mins, d.day AS day_here, bare, {", ".join(f"n.{g}_first AS {g}_after, CASE WHEN {g}_lead > 0 THEN r.{g}_run ELSE r.{g}_seg END AS {g}_front, {g}_follows" for g in ("act", "lang"))}
  FROM placed p JOIN modes USING (k, c) JOIN runs r ON r.k = p.k AND r.c = p.c AND r.seg = p.seg LEFT JOIN runs n ON n.k = p.k AND n.c = p.c AND n.seg = p.seg + 1
  LEFT JOIN (SELECT x.k, x.c, x.i, arg_max(y.day, y.i) AS day FROM placed x JOIN placed y ON x.k = y.k AND x.c = y.c AND y.i < x.i AND y.day IS NOT NULL WHERE x.mins IS NOT NULL GROUP BY ALL) d ON d.k = p.k AND d.c = p.c AND d.i = p.i
  WHERE p.mins IS NOT NULL),
ends AS (SELECT k, c, arg_max({{{{'w': act_front}}}}, i).w AS act_end, arg_max({{{{'w': lang_front}}}}, i).w AS lang_end FROM fronts GROUP BY k, c),
lasting AS (SELECT k, c, day_last, CASE WHEN NOT bare AND (times > 0 OR act_n + lang_n > 0) THEN {{{{'act': CASE WHEN times = 0 THEN act_last WHEN NOT act_follows THEN act_end END, 'lang': CASE WHEN times = 0 THEN lang_last WHEN NOT lang_follows THEN lang_end END}}}} END AS kept FROM modes LEFT JOIN ends USING (k, c)),
since AS (SELECT k, c, last_value(day_last IGNORE NULLS) OVER w AS day_since, last_value(kept IGNORE NULLS) OVER w AS kept FROM lasting WINDOW w AS (PARTITION BY k ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
read AS (SELECT *, {_reading("act")}, {_reading("lang")} FROM fronts JOIN since USING (k, c)),
acts AS (SELECT k, coalesce(day_here, day_since) AS day, mins, unnest(CASE WHEN bare THEN [kept.act] ELSE act_of END) AS act, CASE WHEN bare THEN [kept.lang] ELSE lang_of END AS l FROM read)
SELECT DISTINCT k, day, act, unnest(l) AS lang, mins FROM acts)"""


@query("SELECT k // 3 AS place_id, day, act AS activity, lang AS language, clock AS time FROM {schedule_slots} WHERE k % 3 = 2")
def service_slots(t: Tables) -> DataFrame:
    """What takes place when, by schedules in several languages and layouts."""
    return schedules.slots(t.schedules, "place_id", "schedule")


_FITS = "h.k = w.k + 1 AND h.clock = w.clock AND (w.day IS NULL OR h.day = w.day) AND (w.act IS NULL OR h.act IS NULL OR h.act = w.act) AND (w.lang IS NULL OR h.lang = w.lang)"


@query(f"SELECT k // 3 AS place_id, day, act AS activity, lang AS language, clock AS time FROM {{schedule_slots}} w WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {{schedule_slots}} h WHERE {_FITS})")
def unsupported_slots(t: Tables) -> DataFrame:
    """What schedules claim and their excerpts don't state."""
    return schedules.unsupported(t.schedules, "place_id", "excerpt", "schedule")


@query(f"""
WITH lacking AS (SELECT DISTINCT k // 3 AS place_id FROM {{schedule_slots}} w WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {{schedule_slots}} h WHERE {_FITS})),
plain AS (SELECT place_id, trim(regexp_replace(lower(coalesce(schedule, '')), '\\s+', ' ', 'g')) AS v, trim(regexp_replace(lower(coalesce(excerpt, '')), '\\s+', ' ', 'g')) AS e FROM {{schedules}})
SELECT place_id, lacking.place_id IS NULL OR (v <> '' AND instr(e, v) > 0 AND NOT (instr(e, v) > 1 AND regexp_matches(substr(e, instr(e, v) - 1, 1), '[\\pL\\pN]')) AND NOT regexp_matches(substr(e, instr(e, v) + length(v), 1), '[\\pL\\pN]')) AS supported
FROM plain LEFT JOIN lacking USING (place_id)""")
def supported_schedules(t: Tables) -> DataFrame:
    """Whether excerpts state schedules, slot by slot or word for word."""
    return schedules.supported(t.schedules, "place_id", "excerpt", "schedule")
