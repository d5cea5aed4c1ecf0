"""DuckDB SQL for the library's queries, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from ledgerline.operators.checks import DCR_NOTE, INTRO, OUTRO, QUESTION_TEXTS
from ledgerline.sources.bindings import ALIASES, SHAPES, SPECIAL, SQL, STATES

# Fixed values, stated here anew: questions in order and what they cover, statuses from worst to best, patterns of personal and protected data.
QUESTIONS = "capacity_mismatch capacity_basis panel_details subsidy_not_stated subsidy_breakdown subsidy_higher subsidy_lower dc_capacity exact_capacity total_mismatch net_cost_mismatch panel_wattage panel_count module_model module_choice dcr inverter_model inverter_rating inverter_choice vendor_registration gst_basis extras_outside_total net_meter".split()
COVERS = {"capacity_mismatch": ("panel_details", "panel_count", "panel_wattage"), "panel_details": ("panel_count", "panel_wattage"), "exact_capacity": ("panel_wattage",)}
STATUS_ORDER = ("inconsistent", "needs_confirmation", "missing", "out_of_scope", "consistent")
PERSONAL = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+",
    "id_number": "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b",
    "phone": "(?:\\+91[ -]*|\\b91[ -]*|\\b0|\\b)[6-9][0-9]{4}[ -]?[0-9]{5}\\b",
    "tax_id": "\\b[A-Z]{5}[0-9]{4}[A-Z]\\b",
    "long_number": "\\b[0-9]{9,}\\b",
}
PROTECTED = {"capacity": "\\b[0-9]+(?:\\.[0-9]+)? ?(?:kWp|kW|Wp|kVA)\\b", "amount": "(?:Rs\\.?|₹) ?[0-9][0-9,]*", "percent": "[0-9]+(?:\\.[0-9]+)? ?%", "date": "\\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\\b"}

ORACLES: dict[str, str] = {}


def _with(names: str, *ctes: str) -> str:
    """The derived tables of names and further `x AS (...)` texts; the last item is the query."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()] + list(ctes[:-1])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + ctes[-1]


_states = ", ".join(f"('{k}', '{n}', '{'special' if n in SPECIAL else 'general'}')" for k, n in [*((s.lower(), s) for s in STATES), *ALIASES.items()])
_slab = lambda x: f"CASE category WHEN 'general' THEN least(78000.0, greatest(0, least({x}, 2)) * 30000 + greatest(0, least({x}, 3) - 2) * 18000) WHEN 'special' THEN least(85800.0, greatest(0, least({x}, 2)) * 33000 + greatest(0, least({x}, 3) - 2) * 19800) END"

_near = lambda x, y: f"coalesce({x} > 0 AND {y} > 0 AND (abs(greatest({x}, {y}) / least({x}, {y}) - 10) <= 2 OR abs(greatest({x}, {y}) / least({x}, {y}) - 100) <= 20 OR abs(greatest({x}, {y}) / least({x}, {y}) - 1000) <= 200), false)"

OPTION = """opt AS (SELECT a.quote_id, CASE WHEN selected IS NOT NULL THEN 'selected' WHEN coalesce(n, 0) > 1 THEN 'multiple' WHEN more_options = 'no' THEN 'single' ELSE 'unknown' END AS option_state,
  coalesce(selected, CASE WHEN n = 1 THEN only_one END) AS option_id FROM answers a LEFT JOIN (SELECT quote_id, count(DISTINCT option_id) AS n, max(option_id) AS only_one FROM items GROUP BY quote_id) o USING (quote_id))"""

def _view(told: str = "answers") -> tuple[str, ...]:
    """One row a quotation; `told` names the answers."""
    return (
        OPTION,
        """per AS (SELECT quote_id, count(*) AS n_groups, bool_or(count_state = 'absent' OR watt_state = 'absent') AS any_absent, bool_or(count_state = 'held' OR watt_state = 'held') AS any_held, bool_or(watt_lo <> watt_hi) AS any_range,
      bool_or(count_state = 'absent') AS count_absent, bool_or(count_state = 'held') AS count_held, bool_or(watt_state = 'absent') AS watt_absent, bool_or(make IS NULL) AS make_absent, bool_or(choice) AS make_choice, bool_and(n IS NOT NULL AND watt_lo IS NOT NULL AND watt_lo = watt_hi) AS all_exact, min(n) AS count_least, max(n) AS count_most, min(watt_lo) FILTER (watt_lo = watt_hi) AS watt_least, max(watt_lo) FILTER (watt_lo = watt_hi) AS watt_most, sum(n * watt_lo) AS w_lo, sum(n * watt_hi) AS w_hi
      FROM items JOIN (SELECT quote_id, option_id AS own FROM opt) o USING (quote_id) WHERE option_id IS NULL OR own IS NULL OR option_id = own GROUP BY quote_id)""",
        f"""inv AS (SELECT quote_id, count(*) AS n_inverters, bool_or(make IS NULL AND make_state = 'ok') AS inv_make_absent, bool_or(make_state = 'held') AS inv_make_held, bool_or(choice AND make IS NOT NULL AND make_state = 'ok') AS inv_choice, bool_or(rating_kw IS NULL) AS inv_rating_absent,
      bool_or(rating_kw IS NOT NULL AND rating_state <> 'ok') AS inv_rating_unsure, bool_or(kw < 0.5 OR kw > 20) AS inv_bad, bool_or(kw BETWEEN 0.5 AND 20 AND {_near('kw', 'CAST(stated_kw AS DOUBLE)')}) AS inv_off, count(kw) AS inv_known
      FROM (SELECT *, CASE WHEN rating_state = 'ok' THEN CAST(rating_kw AS DOUBLE) END AS kw FROM inverters) i JOIN quotes USING (quote_id) JOIN (SELECT quote_id, option_id AS own FROM opt) o USING (quote_id) WHERE option_id IS NULL OR own IS NULL OR option_id = own GROUP BY quote_id)""",
        """extra AS (SELECT quote_id, sum(CASE WHEN placed = 'inside' THEN amount END) AS inside, bool_or(placed = 'inside' AND amount IS NULL) AS inside_absent, min(CASE WHEN placed = 'inside' THEN amount END) AS inside_least, bool_or(placed = 'unclear') AS any_unclear, bool_or(placed <> 'inside') AS any_outside, bool_or(regexp_matches(lower(label), 'net[\\s-]*meter')) AS has_net_meter FROM charges GROUP BY quote_id)""",
        f"states(key, state_name, category) AS (VALUES {_states})",
        f"""v0 AS (SELECT q.*, a.* EXCLUDE (quote_id), o.option_state, o.option_id, p.* EXCLUDE (quote_id), n.* EXCLUDE (quote_id), e.* EXCLUDE (quote_id), s.state_name, s.category, coalesce(n_groups > 0 AND NOT any_absent AND NOT any_held, false) AS from_items
      FROM quotes q JOIN {told} a USING (quote_id) JOIN opt o USING (quote_id) LEFT JOIN per p USING (quote_id) LEFT JOIN inv n USING (quote_id) LEFT JOIN extra e USING (quote_id) LEFT JOIN states s ON s.key = trim(regexp_replace(regexp_replace(replace(lower(a.state), '&', ' and '), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')))""",
        """v1 AS (SELECT *, CASE WHEN from_items THEN CAST(w_lo AS DOUBLE) / 1000 WHEN stated_state = 'ok' AND basis = 'dc_kwp' THEN CAST(stated_kw AS DOUBLE) END AS dc_lo,
      CASE WHEN from_items THEN CAST(w_hi AS DOUBLE) / 1000 WHEN stated_state = 'ok' AND basis = 'dc_kwp' THEN CAST(stated_kw AS DOUBLE) END AS dc_hi FROM v0)""",
        f"v AS (SELECT *, CASE WHEN dc_lo IS NOT NULL THEN CAST({_slab('dc_lo')} AS DOUBLE) END AS rule_lo, CASE WHEN dc_hi IS NOT NULL THEN CAST({_slab('dc_hi')} AS DOUBLE) END AS rule_hi FROM v1)",
    )


VIEW = _view()
_all = "quotes items charges inverters answers"
_open = "option_state IN ('multiple', 'unknown')"

C1 = f"""CASE WHEN {_open} THEN '1|needs_confirmation|' WHEN n_groups IS NULL THEN '2|missing|' WHEN any_absent THEN '3|missing|' WHEN any_range THEN '4|needs_confirmation|exact_capacity' WHEN any_held THEN '4|needs_confirmation|panel_details'
  WHEN stated_state = 'kva' AND stated_kw IS NOT NULL THEN '5|needs_confirmation|capacity_basis' WHEN stated_state = 'held' AND stated_kw IS NOT NULL THEN '6|needs_confirmation|dc_capacity' WHEN stated_kw IS NULL THEN '7|missing|'
  WHEN basis IS NULL OR basis <> 'dc_kwp' THEN '8|needs_confirmation|capacity_basis' WHEN abs(w_lo - 1000 * stated_kw) <= 10 THEN '9|consistent|' ELSE '10|inconsistent|capacity_mismatch' END"""
C2 = f"""CASE WHEN NOT complete THEN '1|needs_confirmation|' WHEN {_open} THEN '2|needs_confirmation|' WHEN consumer IN ('rwa', 'group_housing') THEN '3|out_of_scope|' WHEN consumer IS NULL THEN '4|needs_confirmation|'
  WHEN category IS NULL THEN '5|needs_confirmation|' WHEN after_cutoff = 'no' THEN '6|out_of_scope|' WHEN after_cutoff IS NULL THEN '7|needs_confirmation|' WHEN first_system = 'no' OR prior_subsidy = 'yes' THEN '8|out_of_scope|'
  WHEN first_system IS NULL OR prior_subsidy IS NULL THEN '9|needs_confirmation|' WHEN give_up = 'yes' THEN '10|out_of_scope|' WHEN give_up_quoted = 'yes' THEN '11|needs_confirmation|'
  WHEN central IS NULL AND (combined IS NOT NULL OR unspecified IS NOT NULL) THEN '12|needs_confirmation|subsidy_breakdown' WHEN central IS NULL THEN '13|needs_confirmation|subsidy_not_stated' WHEN dc_lo IS NULL THEN '14|needs_confirmation|dc_capacity'
  WHEN rule_lo <> rule_hi THEN '15|needs_confirmation|exact_capacity' WHEN abs(central - rule_lo) <= 1 THEN '16|consistent|' WHEN central > rule_lo AND (NOT from_items OR any_range) THEN '17|needs_confirmation|subsidy_higher'
  WHEN central > rule_lo THEN '18|inconsistent|subsidy_higher' ELSE '19|needs_confirmation|subsidy_lower' END"""
C3A = f"""CASE WHEN {_open} THEN '1|needs_confirmation|' WHEN total IS NULL OR base IS NULL OR (gst_basis = 'excluded' AND gst IS NULL) OR coalesce(inside_absent, false) THEN '2|missing|' WHEN base < 0 OR total < 0 OR (gst_basis = 'excluded' AND gst < 0) OR coalesce(discount, 0) < 0 OR coalesce(inside_least, 0) < 0 THEN '3|needs_confirmation|' WHEN gst_basis IS NULL THEN '4|needs_confirmation|'
  WHEN any_unclear THEN '5|needs_confirmation|' WHEN list_complete IS NULL OR list_complete = 'no' THEN '6|needs_confirmation|' WHEN abs(base + CASE WHEN gst_basis = 'excluded' THEN gst ELSE 0 END + coalesce(inside, 0) - coalesce(discount, 0) - total) <= 1 THEN '7|consistent|' ELSE '8|inconsistent|total_mismatch' END"""
C3B = f"""CASE WHEN {_open} THEN '1|needs_confirmation|' WHEN total IS NULL OR net IS NULL OR (subsidy_basis IN ('central', 'both') AND central IS NULL) OR (subsidy_basis IN ('state', 'both') AND state_subsidy IS NULL) OR (subsidy_basis = 'combined' AND combined IS NULL) THEN '2|missing|'
  WHEN total < 0 OR net < 0 OR (subsidy_basis IN ('central', 'both') AND central < 0) OR (subsidy_basis IN ('state', 'both') AND state_subsidy < 0) OR (subsidy_basis = 'combined' AND combined < 0) THEN '3|needs_confirmation|' WHEN subsidy_basis IS NULL THEN '4|needs_confirmation|'
  WHEN abs(total - CASE WHEN subsidy_basis IN ('central', 'both') THEN central ELSE 0 END - CASE WHEN subsidy_basis IN ('state', 'both') THEN state_subsidy ELSE 0 END - CASE WHEN subsidy_basis = 'combined' THEN combined ELSE 0 END - net) <= 1 THEN '5|consistent|' ELSE '6|inconsistent|net_cost_mismatch' END"""
_split = "CAST(split_part(o, '|', 1) AS INT) AS gate, split_part(o, '|', 2) AS status, nullif(split_part(o, '|', 3), '') AS question"


def _check(case: str) -> str:
    return _with(_all, *VIEW, f"SELECT quote_id, {_split} FROM (SELECT quote_id, {case} AS o FROM v)")


C4 = f"""d AS (SELECT quote_id, {_open} AS open_, unnest([
  CASE WHEN n_groups IS NULL OR watt_absent THEN 'panel_wattage|missing|panel_wattage' WHEN any_range THEN 'panel_wattage|needs_confirmation|exact_capacity' END,
  CASE WHEN n_groups IS NULL OR count_absent THEN 'panel_count|missing|panel_count' WHEN count_held THEN 'panel_count|needs_confirmation|panel_count' END,
  CASE WHEN n_groups IS NULL OR make_absent THEN 'module_make_model|missing|module_model' WHEN make_choice THEN 'module_make_model|needs_confirmation|module_choice' END,
  CASE WHEN dcr IS NULL THEN 'dcr_declaration|missing|dcr' WHEN dcr IN ('non_dcr', 'held') THEN 'dcr_declaration|needs_confirmation|dcr' END,
  CASE WHEN n_inverters IS NULL OR inv_make_absent THEN 'inverter_make_model|missing|inverter_model' WHEN inv_make_held THEN 'inverter_make_model|needs_confirmation|inverter_model' WHEN inv_choice THEN 'inverter_make_model|needs_confirmation|inverter_choice' END,
  CASE WHEN n_inverters IS NULL OR inv_rating_absent THEN 'inverter_rating|missing|inverter_rating' WHEN inv_rating_unsure THEN 'inverter_rating|needs_confirmation|inverter_rating' END,
  CASE WHEN registration IS NULL THEN 'vendor_registration|missing|vendor_registration' END, CASE WHEN gst_basis IS NULL THEN 'gst_basis|needs_confirmation|gst_basis' END,
  CASE WHEN any_outside THEN 'extras_outside_total|needs_confirmation|extras_outside_total' END, CASE WHEN NOT coalesce(has_net_meter, false) THEN 'net_meter|needs_confirmation|net_meter' END]) AS o FROM v),
c4 AS (SELECT quote_id, o FROM d WHERE o IS NOT NULL AND NOT open_ UNION ALL SELECT quote_id, 'details|needs_confirmation|' FROM v WHERE {_open} UNION ALL SELECT quote_id, 'details|consistent|' FROM v WHERE NOT {_open} AND quote_id NOT IN (SELECT quote_id FROM d WHERE o IS NOT NULL))"""
FINDINGS = (*VIEW, C4, f"""f AS (SELECT quote_id, split_part(o, '|', 2) AS status, nullif(split_part(o, '|', 3), '') AS question FROM (
  SELECT quote_id, {C1} AS o FROM v UNION ALL SELECT quote_id, {C2} FROM v UNION ALL SELECT quote_id, {C3A} FROM v UNION ALL SELECT quote_id, {C3B} FROM v UNION ALL SELECT quote_id, o FROM c4))""")
_cover = ", ".join(f"('{a}', '{b}')" for a, bs in COVERS.items() for b in bs)
_order = ", ".join(f"('{q}', {i})" for i, q in enumerate(QUESTIONS))
ASKED = (*FINDINGS, f"cover(by_, question) AS (VALUES {_cover})", f"places(question, place) AS (VALUES {_order})", "asked AS (SELECT DISTINCT quote_id, question FROM f WHERE question IS NOT NULL)",
    "vq AS (SELECT quote_id, row_number() OVER (PARTITION BY quote_id ORDER BY place) AS number, a.question FROM asked a JOIN places USING (question) WHERE NOT EXISTS (SELECT 1 FROM asked b JOIN cover c ON c.by_ = b.question WHERE b.quote_id = a.quote_id AND c.question = a.question))")

_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_grouped = lambda w: f"CASE WHEN {w} < 1000 THEN CAST({w} AS VARCHAR) ELSE reverse(regexp_replace(regexp_replace(reverse(CAST({w} // 1000 AS VARCHAR)), '([0-9]{{2}})', '\\1,', 'g'), ',$', '')) || ',' || right(CAST({w} AS VARCHAR), 3) END"
_money_text = lambda x: f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || {_grouped(f'CAST(floor(abs(CAST({x} AS DECIMAL(18, 2)))) AS BIGINT)')} || CASE WHEN CAST({x} AS DECIMAL(18, 2)) = floor(CAST({x} AS DECIMAL(18, 2))) THEN '' ELSE '.' || right(CAST(CAST({x} AS DECIMAL(18, 2)) AS VARCHAR), 2) END"
_number_text = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(18, 6)) AS VARCHAR), '[.]?0+$', '')"
_own = "JOIN (SELECT quote_id, option_id AS own FROM opt) o USING (quote_id) WHERE (option_id IS NULL OR own IS NULL OR option_id = own) AND choice AND make IS NOT NULL"
_panels = {"computed_kwp": _number_text("CAST(w_lo AS DOUBLE) / 1000"), "stated": f"{_number_text('stated_kw')} || CASE stated_state WHEN 'kva' THEN ' kVA' ELSE ' kW' END"}
_rule = {"stated": _money_text("central"), "rule": _money_text("rule_lo"), "dc_kwp": f"{_number_text('dc_lo')} || CASE WHEN dc_lo = dc_hi THEN '' ELSE ' to ' || {_number_text('dc_hi')} END"}
_added = "(base + CASE WHEN gst_basis = 'excluded' THEN gst ELSE 0 END + coalesce(inside, 0) - coalesce(discount, 0))"
_less = "(total - CASE WHEN subsidy_basis IN ('central', 'both') THEN central ELSE 0 END - CASE WHEN subsidy_basis IN ('state', 'both') THEN state_subsidy ELSE 0 END - CASE WHEN subsidy_basis = 'combined' THEN combined ELSE 0 END)"
_places = {
    "capacity_mismatch": _panels, "capacity_basis": _panels, "subsidy_higher": _rule, "subsidy_lower": _rule, "total_mismatch": {"computed": _money_text(_added), "stated": _money_text("total")}, "net_cost_mismatch": {"computed": _money_text(_less), "stated": _money_text("net")},
    "module_choice": {"options": "panel_options"}, "inverter_choice": {"options": "inverter_options"}, "extras_outside_total": {"charges": "outside_charges"},
}


def _asked_text(question: str) -> str:
    text = _quoted(QUESTION_TEXTS[question])
    for name, x in _places.get(question, {}).items():
        text = f"replace({text}, '{{{name}}}', {x})"
    return text


TEXTS = (
    *ASKED, f"po AS (SELECT quote_id, string_agg(concat_ws(' or ', make, other_make), '; ' ORDER BY item_id) AS panel_options FROM items {_own} GROUP BY quote_id)",
    f"io AS (SELECT quote_id, string_agg(concat_ws(' or ', make, other_make), '; ' ORDER BY inverter_id) AS inverter_options FROM inverters {_own} AND make_state = 'ok' GROUP BY quote_id)",
    f"oc AS (SELECT quote_id, string_agg(coalesce(label, 'an extra charge') || ': ' || coalesce('₹' || {_money_text('amount')}, 'amount not given') || CASE placed WHEN 'outside' THEN ', outside the total' ELSE ', not clearly inside the total' END, '; ' ORDER BY charge_id) AS outside_charges FROM charges WHERE placed <> 'inside' GROUP BY quote_id)",
    f"tq AS (SELECT vq.quote_id, vq.number, vq.question, CASE vq.question {' '.join(f'WHEN {_quoted(q)} THEN {_asked_text(q)}' for q in QUESTIONS)} END AS text FROM vq JOIN v USING (quote_id) LEFT JOIN po USING (quote_id) LEFT JOIN io USING (quote_id) LEFT JOIN oc USING (quote_id))",
)
_RAW = "\"Total \\\"Rs ' || total || '\\\"\""
_operand = lambda field, c, raw="null": f"""CASE WHEN {c} IS NOT NULL THEN '{{"field": "{field}", "provenance": "read", "raw": {raw}, "source": null, "value": "' || {c} || '"}}' END"""

_ranges = {"base": (10000, 3000000), "gst": (0, 600000), "total": (10000, 3000000), "net": (10000, 3000000), "discount": (0, 600000), "central": (0, 200000), "state_subsidy": (0, 200000), "combined": (0, 200000), "unspecified": (0, 200000), "stated_kw": (0.5, 20)}
_out = lambda *fs: " OR ".join(f"coalesce({f} < {_ranges[f][0]} OR {f} > {_ranges[f][1]}, false)" for f in fs)
_money = ("central", "state_subsidy", "combined", "unspecified")
_double = lambda x: f"CAST({x} AS DOUBLE)"
_related = {
    "panels": (("panel_count", "panel_wattage", "stated_kw"), _near("CASE WHEN all_exact THEN CAST(w_lo AS DOUBLE) / 1000 END", _double("stated_kw"))),
    "total_": (("base", "gst", "total"), _near(_double("base + coalesce(gst, 0)"), _double("total"))),
    "net_": (("total", *_money, "net"), _near(_double("total - " + " - ".join(f"coalesce({x}, 0)" for x in _money)), _double("net"))),
}
_bad = {**{f: _out(f) for f in _ranges}, "panel_count": "coalesce(count_least < 1 OR count_most > 100, false)", "panel_wattage": "coalesce(watt_least < 100 OR watt_most > 800, false)", "inverter_rating": "coalesce(inv_bad, false)"}
_known = {**{f: f"{f} IS NOT NULL" for f in _ranges}, "panel_count": "count_most IS NOT NULL", "panel_wattage": "watt_most IS NOT NULL", "inverter_rating": "inv_known > 0"}
_why = {f: " OR ".join(["false", *[f"r_{r}" for r, (ms, _) in _related.items() if f in ms], *(["r_inverter"] if f in ("inverter_rating", "stated_kw") else [])]) for f in _bad}
GUARDS = (
    "g0 AS (SELECT *, " + ", ".join(f"{x} AS b_{f}" for f, x in _bad.items()) + ", " + ", ".join(f"{x} AND NOT ({' OR '.join(f'b_{m}' for m in ms)}) AS r_{r}" for r, (ms, x) in _related.items()) + ", coalesce(inv_off, false) AND NOT b_stated_kw AS r_inverter FROM v)",
    "g AS (" + " UNION ALL ".join(f"SELECT quote_id, '{f}' AS field, CASE WHEN b_{f} THEN 'range' ELSE 'relation' END AS reason FROM g0 WHERE b_{f} OR ({_known[f]} AND ({_why[f]}))" for f in _bad) + ")",
)

ORACLES |= {
    "subsidy_slab_amount": _with(_all, *VIEW, "SELECT quote_id, state_name, category, dc_lo, dc_hi, rule_lo, rule_hi FROM v WHERE rule_lo IS NOT NULL"),
    "option_states": _with("items answers", OPTION, "SELECT * FROM opt"),
    "capacity_check": _check(C1), "subsidy_gate_outcomes": _check(C2), "gross_total_check": _check(C3A), "net_cost_check": _check(C3B),
    "missing_details": _with(_all, *VIEW, C4, "SELECT quote_id, split_part(o, '|', 1) AS item, split_part(o, '|', 2) AS status, nullif(split_part(o, '|', 3), '') AS question FROM c4"),
    "finding_summary": _with(_all, *FINDINGS, f"SELECT quote_id, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in STATUS_ORDER)}, list_extract(list_sort(list(list_position({list(STATUS_ORDER)}, status))), 1) AS w, CASE w WHEN 1 THEN 'inconsistent' WHEN 2 THEN 'needs_confirmation' WHEN 3 THEN 'missing' WHEN 4 THEN 'out_of_scope' ELSE 'consistent' END AS worst FROM f GROUP BY quote_id").replace("SELECT quote_id, count(*) FILTER", "SELECT * EXCLUDE (w) FROM (SELECT quote_id, count(*) FILTER").replace("FROM f GROUP BY quote_id", "FROM f GROUP BY quote_id)"),
    "vendor_questions": _with(_all, *TEXTS, "SELECT * FROM tq"),
    "vendor_messages": _with(_all, *TEXTS, f"SELECT quote_id, {_quoted(INTRO)} || chr(10) || chr(10) || string_agg(number || '. ' || text, chr(10) ORDER BY number) || chr(10) || chr(10) || {_quoted(OUTRO)} AS message FROM tq GROUP BY quote_id"),
    "operand_tokens": _with("quotes items answers", OPTION, f"""SELECT quote_id, left(sha256('{{"check": "C3a", "item": null, "operands": [' || array_to_string(list_filter([{_operand('gross_total', 'total', _RAW)}, {_operand('base_price', 'base')}, {_operand('gst_amount', 'gst')}, {_operand('discount', 'discount')}], lambda x: x IS NOT NULL), ', ') || '], "option": ' || coalesce('"' || option_id || '"', 'null') || '}}'), 24) AS token FROM quotes JOIN opt USING (quote_id) WHERE coalesce(total, base, gst, discount) IS NOT NULL"""),
    "subsidy_notes": _with(_all, *VIEW, f"SELECT status, notes, count(*) AS n FROM (SELECT split_part({C2}, '|', 2) AS status, {_quoted(DCR_NOTE)} || ' The rule values were checked against the MNRE guidelines on ' || (SELECT strftime(DATE '2024-01-01' + CAST(max(n_nationkey) AS INT), '%-d %b %Y') FROM nation WHERE n_nationkey % 3 = 0) || '.' AS notes FROM v) GROUP BY ALL"),
    "charge_guards": _with("charges", "SELECT quote_id, 'extra_charges[' || charge_id || '].amount' AS field, 'range' AS reason FROM charges WHERE 10 * amount < 0 OR 10 * amount > 300000"),
    "held_findings": _with(_all, *VIEW, f"SELECT quote_id, CASE WHEN (quote_id % 2 = 1 OR quote_id % 6 = 0) AND status IN ('consistent', 'inconsistent') THEN 'needs_confirmation' ELSE status END AS status, CASE WHEN (quote_id % 2 = 1 OR quote_id % 6 = 0) AND status IN ('consistent', 'inconsistent') THEN 'confirm_values' ELSE question END AS question FROM (SELECT quote_id, {_split} FROM (SELECT quote_id, {C3A} AS o FROM v))"),
    "state_categories": _with("answers", f"states(key, state_name, category) AS (VALUES {_states})", "SELECT category, count(*) AS n FROM answers a LEFT JOIN states s ON s.key = trim(regexp_replace(regexp_replace(replace(lower(a.state), '&', ' and '), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) GROUP BY category"),
    "amount_parse_roundtrip": _with("quotes", "SELECT quote_id, base AS amount, 'ok' AS parse_status FROM quotes WHERE base >= 0"),
    "indian_grouping": _with("quotes", "SELECT quote_id, CASE WHEN base < 1000 THEN CAST(base AS VARCHAR) ELSE reverse(regexp_replace(regexp_replace(reverse(CAST(base // 1000 AS VARCHAR)), '([0-9]{2})', '\\1,', 'g'), ',$', '')) || ',' || right(CAST(base AS VARCHAR), 3) END AS shown FROM quotes WHERE base > 0"),
    "capacity_parse_roundtrip": _with("items", "SELECT quote_id, item_id, watt_lo AS lo, watt_hi AS hi, 'wp' AS unit FROM items WHERE watt_lo IS NOT NULL"),
    "parse_status_profile": _with("lines", "SELECT 'line' AS field, CASE WHEN line_no IN (1, 2, 3, 4) THEN 'ambiguous' ELSE 'unparseable' END AS parse_status, count(*) AS n FROM lines GROUP BY ALL"),
    "line_roles": _with("lines", "SELECT doc, line_no, CASE line_no WHEN 1 THEN 'gross_total' WHEN 2 THEN 'gst_amount' END AS role, line_no = 5 AS denied FROM lines"),
    "one_amount_lines": _with("lines", "SELECT doc, line_no, CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS amount FROM lines WHERE line_no IN (1, 2)"),
    "line_candidates": _with("lines", "SELECT doc, line_no, CASE line_no WHEN 1 THEN 'gross_total' WHEN 2 THEN 'gst_amount' WHEN 3 THEN 'panel_count' ELSE 'system_size' END AS field, CASE line_no WHEN 4 THEN regexp_extract(text, '([0-9]+)', 1) || '000' ELSE regexp_extract(text, '([0-9]+)', 1) END AS value FROM lines WHERE confidence >= 50 AND (line_no IN (1, 2, 4) OR line_no = 3 AND doc % 12 + 1 >= 2)"),
    "line_sections": _with("lines", "t AS (SELECT doc, page, line_no, y0, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM lines)",
        "h AS (SELECT doc, page, line_no, y0, CASE WHEN regexp_matches(t, '^(buyer|customer|client|recipient|consignee|purchaser|consumer|sold to|bill(ed)? to|ship(ped)? to|to ?[,:]?$)') THEN 'buyer' ELSE 'supplier' END AS kind FROM t WHERE len(string_split(t, ' ')) <= 4 AND regexp_matches(t, '^(buyer|customer|client|recipient|consignee|purchaser|consumer|sold to|bill(ed)? to|ship(ped)? to|to ?[,:]?$|((quotation )?from|supplier|vendor|seller|our)\\b)'))",
        "o AS (SELECT doc, page, line_no, y0, CASE WHEN lag(kind) OVER w <> kind AND abs(y0 - lag(y0) OVER w) < 0.02 * 110 THEN 'unclear' ELSE kind END AS opened FROM h WINDOW w AS (PARTITION BY doc, page ORDER BY y0, line_no))",
        "SELECT l.doc, l.line_no, CASE WHEN count(o.doc) = 0 THEN 'unclear' ELSE coalesce(max_by(opened, (o.y0, o.line_no)) FILTER ((o.y0, o.line_no) <= (l.y0, l.line_no)), 'letterhead') END AS section FROM lines l LEFT JOIN o USING (doc, page) GROUP BY l.doc, page, l.line_no"),
    "gst_flags": _with("lines", "SELECT doc, 'excluded' AS gst, confidence FROM lines WHERE line_no = 2"),
    "resolve_occurrences": _with("facts", "c AS (SELECT doc, value AS occurrence, field, CASE WHEN pos % 2 = 0 THEN field ELSE 'other' END AS r FROM facts)", "k AS (SELECT doc, occurrence, count(DISTINCT field) AS nf, count(DISTINCT CASE WHEN field = r THEN field END) AS nn, max(CASE WHEN field = r THEN field END) AS one FROM c GROUP BY ALL)", "SELECT doc, count(*) AS n FROM c JOIN k USING (doc, occurrence) WHERE nf = 1 OR (nn = 1 AND field = one) GROUP BY doc"),
    "distinct_values": _with("facts", "SELECT doc, field, value, min(pos) AS pos FROM facts GROUP BY ALL"),
    "fact_provenance": _with("facts", "SELECT doc, field, value, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (rule <> 'unmatched'), 'unmatched') AS rules, min(confidence) FILTER (rule <> 'unmatched') AS confidence FROM facts GROUP BY doc, field, value"),
    "item_bindings": _with("facts", "r AS (SELECT DISTINCT doc, field, value FROM facts WHERE batch = 1)", "SELECT CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.doc = f.doc AND r.field = f.field AND r.value = f.value) THEN 'confirmed' WHEN EXISTS (SELECT 1 FROM r WHERE r.doc = f.doc AND r.field = f.field) THEN 'conflict' ELSE 'fill' END AS binding, count(*) AS n FROM facts f WHERE batch = 2 GROUP BY 1"),
    "evidence_status": "SELECT CASE WHEN o_orderkey % 5 = 0 AND NOT (floor(o_totalprice) = 1) THEN 'mismatch' ELSE 'text_matched' END AS evidence_status, 6 * count(*) AS n FROM orders GROUP BY 1",
    "answer_gate": _with("lines", "p AS (SELECT doc, min(confidence) FILTER (contains(replace(text, ' ', ''), '999')) AS least FROM lines GROUP BY doc)", "SELECT why, why IS NULL AS kept, count(*) AS n FROM (SELECT CASE WHEN confidence < 50 THEN 'low_confidence' WHEN doc % 3 = 2 OR doc % 3 = 1 AND line_no <> 1 THEN 'unparsed' WHEN doc % 3 = 0 AND least IS NULL THEN 'not_on_page' WHEN doc % 3 = 0 AND least < 50 THEN 'low_confidence' WHEN doc % 3 = 0 THEN 'not_an_amount_on_its_line' END AS why FROM lines JOIN p USING (doc)) GROUP BY why"),
    "merge_fields": _with("facts", "SELECT doc, field, CASE WHEN count(DISTINCT value) = 1 AND NOT bool_or(flagged) THEN min(value) END AS value, count(DISTINCT value) > 1 OR bool_or(flagged) AS conflict, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS candidates FROM facts GROUP BY doc, field"),
    "merge_alternatives": _with("facts", "SELECT doc, field, string_agg(value, '|' ORDER BY pos) AS alternatives FROM (SELECT doc, field, value, min(pos) AS pos FROM facts GROUP BY ALL) GROUP BY doc, field"),
    "match_items": _with("facts", "g AS (SELECT DISTINCT doc, batch FROM facts)", "w AS (SELECT DISTINCT doc, value FROM facts)", "n AS (SELECT w.doc, w.value, g.batch, (SELECT count(*) FROM facts f WHERE f.doc = w.doc AND f.value = w.value AND f.batch = g.batch) AS n FROM w JOIN g USING (doc))", "SELECT doc, value, min(n) = max(n) AS matched, unnest(range(1, max(n) + 1)) AS nth FROM n GROUP BY doc, value"),
    "match_charges": _with("facts", "g AS (SELECT DISTINCT doc, field, batch FROM facts)", "w AS (SELECT DISTINCT doc, field, value FROM facts)", "n AS (SELECT w.doc, w.field, w.value, g.batch, (SELECT count(*) FROM facts f WHERE f.doc = w.doc AND f.field = w.field AND f.value = w.value AND f.batch = g.batch) AS n FROM w JOIN g USING (doc, field))", "SELECT doc, field AS label, value, min(n) = max(n) AS matched, unnest(range(1, max(n) + 1)) AS nth FROM n GROUP BY doc, field, value"),
    "merge_lists": _with("facts", "m AS (SELECT doc, value, unnest(range(1, max(n) + 1)) AS nth FROM (SELECT doc, value, batch, count(*) AS n FROM facts GROUP BY ALL) GROUP BY doc, value)", "SELECT doc, value, nth, 'G' || row_number() OVER (PARTITION BY doc ORDER BY value, nth) AS item_id FROM m"),
    "merge_quotes": _with("facts", "b AS (SELECT doc, batch, min(confidence) < 42 AS failed FROM facts GROUP BY ALL)", "p AS (SELECT doc, count(DISTINCT pos) AS pages FROM facts JOIN b USING (doc, batch) WHERE NOT failed GROUP BY doc)", "c AS (SELECT doc, field FROM facts GROUP BY ALL HAVING count(DISTINCT value) > 1 OR bool_or(flagged))", "k AS (SELECT doc, count(*) AS n, string_agg(field, ',' ORDER BY field) AS s FROM c GROUP BY doc)", "SELECT doc, NOT bool_or(failed) AS complete, coalesce(any_value(p.pages), 0) AS pages_done, count(*) FILTER (failed) AS n_failed, coalesce(any_value(k.n), 0) AS n_conflicts, coalesce(any_value(k.s), '') AS conflicts FROM b LEFT JOIN p USING (doc) LEFT JOIN k USING (doc) GROUP BY doc"),
    "plan_batches": """WITH RECURSIVE g AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS page, max(l_partkey * 97 % 1000) AS bytes FROM lineitem GROUP BY ALL),
o AS (SELECT doc, bytes, row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM g WHERE bytes <= 950),
r AS (SELECT doc, i, 1 AS batch, 1 AS n, bytes AS size FROM o WHERE i = 1 UNION ALL SELECT o.doc, o.i, CASE WHEN r.n >= 5 OR r.size + o.bytes > 950 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 5 OR r.size + o.bytes > 950 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 5 OR r.size + o.bytes > 950 THEN o.bytes ELSE r.size + o.bytes END FROM r JOIN o ON o.doc = r.doc AND o.i = r.i + 1)
SELECT g.doc, any_value(m.n_batches) AS n_batches, count(*) FILTER (g.bytes > 950) AS n_rejected FROM g LEFT JOIN (SELECT doc, max(batch) AS n_batches FROM r GROUP BY doc) m USING (doc) GROUP BY g.doc""",
    "apply_corrections": _with("facts", "m AS (SELECT doc, field, CASE WHEN count(DISTINCT value) = 1 AND NOT bool_or(flagged) THEN min(value) END AS value FROM facts GROUP BY ALL)", "n AS (SELECT *, CASE WHEN doc % 6 = 0 THEN '8' WHEN doc % 3 = 0 THEN '9' END AS nv FROM m)", "SELECT doc, field, coalesce(nv, value) AS value, CASE WHEN nv IS NOT NULL THEN value END AS original, nv IS NOT NULL AS corrected FROM n"),
    "check_this": _with("facts", "m AS (SELECT doc, field, count(DISTINCT value) > 1 OR bool_or(flagged) AS c, doc % 4 <> 0 AND min(confidence) < 80 AS l, doc % 4 <> 0 AND bool_or(rule IN ('line', 'unmatched')) AS s FROM facts GROUP BY doc, field)", "SELECT doc, field, concat_ws(',', CASE WHEN c THEN 'conflict' END, CASE WHEN l THEN 'low_confidence' END, CASE WHEN s THEN 'source_rule' END) AS reasons FROM m WHERE c OR l OR s"),
    "entry_guards": _with(_all, *VIEW, *GUARDS, "SELECT * FROM g"),
    "confirm_tokens": _with("quotes", """SELECT quote_id, left(sha256('{"quote_id": "' || quote_id || '", "total": ' || coalesce('"' || total || '"', 'null') || '}'), 24) AS token FROM quotes"""),
}

SCORES = ("m AS (SELECT doc, field, CASE WHEN count(DISTINCT value) = 1 AND NOT bool_or(flagged) THEN min(value) END AS value, count(DISTINCT value) > 1 OR bool_or(flagged) AS conflict, min(value) AS first_ FROM facts GROUP BY ALL)",
    """s AS (SELECT doc, field, CASE WHEN doc % 7 = 0 THEN 'not_labelled' WHEN doc % 4 = 0 THEN CASE WHEN doc % 5 <> 0 THEN 'falsely_populated' ELSE 'abstained' END WHEN doc % 5 = 0 THEN 'missing' WHEN conflict THEN 'conflict_flagged' WHEN value = first_ THEN 'correct' ELSE 'wrong' END AS status
  FROM m WHERE doc % 5 <> 0 OR doc % 7 <> 0)""")  # fmt: skip
_c = lambda s: f"count(*) FILTER (status = '{s}')"
_stated = "count(*) FILTER (status IN ('correct', 'wrong', 'missing', 'conflict_flagged'))"
_none = "count(*) FILTER (status IN ('falsely_populated', 'abstained'))"
_personal = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, text, '{p}' AS p FROM documents WHERE regexp_matches(text, '{p}')" for k, p in PERSONAL.items())
_mask = "text"
for _k, _p in PERSONAL.items():
    _mask = f"regexp_replace({_mask}, '{_p}', '[{_k}]', 'g')"

ORACLES |= {
    "score_fields": _with("facts", *SCORES, "SELECT * FROM s"),
    "score_summary": _with("facts", *SCORES, f"SELECT field, count(*) AS n, round({_c('correct')} / nullif({_stated}, 0), 3) AS accuracy, round({_c('falsely_populated')} / nullif({_none}, 0), 3) AS false_population_rate FROM s GROUP BY field"),
    "score_rollup": _with("facts", *SCORES, f"SELECT field, {', '.join(f'{_c(x)} AS {x}' for x in ('correct', 'wrong', 'missing', 'conflict_flagged', 'falsely_populated', 'abstained'))}, CAST(grouping(field) AS INT) AS is_total FROM s GROUP BY ROLLUP (field)"),
    "score_by_document": _with("facts", *SCORES, f"SELECT doc, {', '.join(f'{_c(x)} AS {x}' for x in ('correct', 'wrong', 'missing', 'conflict_flagged', 'falsely_populated', 'abstained'))}, CAST(grouping(doc) AS INT) AS is_total FROM s GROUP BY ROLLUP (doc)"),
    "model_totals": "SELECT event_type AS model, count(*) AS n_batches, count_if(user_id % 9 = 0) AS n_failed, CAST(sum(floor(value)) AS BIGINT) AS seconds, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY event_type",
    "model_comparison": _with("facts", *SCORES, "SELECT doc, field, status AS one, CASE WHEN doc % 2 = 0 THEN status END AS two FROM s WHERE status <> 'not_labelled'"),
    "confidence_buckets": _with("facts", "g AS (SELECT unnest([0, 50, 60, 70, 80, 90, 95]) AS bucket)", "k AS (SELECT unnest(['money', 'other']) AS kind)", "f AS (SELECT CASE WHEN confidence >= 95 THEN 95 WHEN confidence >= 90 THEN 90 WHEN confidence >= 80 THEN 80 WHEN confidence >= 70 THEN 70 WHEN confidence >= 60 THEN 60 WHEN confidence >= 50 THEN 50 ELSE 0 END AS bucket, CASE WHEN field = 'net' THEN 'other' ELSE 'money' END AS kind, rule <> 'unmatched' AS kept FROM facts)", "SELECT bucket, kind, count(f.kept) AS n, count(*) FILTER (f.kept) AS kept FROM g CROSS JOIN k LEFT JOIN f USING (bucket, kind) GROUP BY ALL"),
    "scenario_matrix": _with(_all, "scen(scenario, s_, a_, c_) AS (VALUES ('S-A', 'Gujarat', 'yes', 'household'), ('S-B', 'Assam', 'yes', 'household'), ('S-C', 'Gujarat', 'no', 'household'), ('S-D', NULL, NULL, NULL), ('S-E', 'Gujarat', 'yes', 'rwa'))",
        "told AS (SELECT scenario, a.* REPLACE (s_ AS state, a_ AS after_cutoff, c_ AS consumer) FROM answers a, scen)", *_view("told"), f"SELECT scenario, split_part(o, '|', 2) AS status, count(*) AS n FROM (SELECT scenario, {C2} AS o FROM v) GROUP BY ALL"),
    "recheck_findings": _with("quotes", "SELECT CASE WHEN abs(base + gst - coalesce(discount, 0) - total) <= 1 THEN 'agree' ELSE 'disagree' END AS result, count(*) AS n FROM quotes GROUP BY 1"),
    "operands_in_text": _with("quotes lines", "t AS (SELECT doc, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+')))) AS ns FROM lines GROUP BY doc)", "SELECT coalesce(list_contains(ns, CAST(base AS VARCHAR)), false) AS found, count(*) AS n FROM quotes LEFT JOIN t ON doc = quote_id GROUP BY 1"),
    "keyword_groups": " UNION ALL ".join(f"SELECT doc_id, '{g}' AS \"group\", len(regexp_extract_all(lower(text), '{p}')) AS hits FROM documents WHERE regexp_matches(lower(text), '{p}')" for g, p in {"of": r"\bof\b", "the": r"\bthe\b", "license": "licen[cs]e"}.items()),
    "label_disagreement": "SELECT doc_id FROM (SELECT doc_id, 1 AS hit FROM documents WHERE regexp_matches(lower(text), 'licen[cs]e')) FULL JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) WHERE coalesce(hit, 0) <> coalesce(quality, 0)",
    "split_guard": "WITH r AS (SELECT DISTINCT c_custkey % 11 AS run_id, c_nationkey AS doc FROM customer), h AS (SELECT n_nationkey AS doc FROM nation WHERE n_regionkey = 1), p AS (SELECT run_id, count(h.doc) AS k, count(*) AS n FROM r LEFT JOIN h USING (doc) GROUP BY run_id), q AS (SELECT *, CASE WHEN k > 0 THEN row_number() OVER (PARTITION BY k > 0 ORDER BY run_id) END AS a FROM p) SELECT run_id, reason FROM (SELECT run_id, CASE WHEN k > 0 AND k < n THEN 'pooled' WHEN k > 0 AND k < (SELECT count(*) FROM h) THEN 'part' WHEN a > 1 THEN 'again' END AS reason FROM q) WHERE reason IS NOT NULL",
    "page_total_audit": "SELECT o_orderkey AS doc, o_orderkey % 4 + 4 AS stated_pages, 6 AS n_pages FROM orders WHERE o_orderkey % 4 + 4 <> 6",
    "translation_problems": _with("lines", "s AS (SELECT doc * 10 + line_no AS id, text, CASE WHEN doc % 6 = 0 THEN replace(text, '1', '7') ELSE text END AS t FROM lines)", "a AS (SELECT id, unnest(regexp_extract_all(text, '[0-9][0-9,.]*[0-9]|[0-9]')) AS piece FROM s)", "b AS (SELECT id, unnest(regexp_extract_all(t, '[0-9][0-9,.]*[0-9]|[0-9]')) AS piece FROM s)", "SELECT id, piece FROM (SELECT id, piece, count(*) AS x FROM a GROUP BY ALL) FULL JOIN (SELECT id, piece, count(*) AS y FROM b GROUP BY ALL) USING (id, piece) WHERE coalesce(x, 0) <> coalesce(y, 0)"),
    "pii_in_conversations": "SELECT kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m FROM conversations" for k, p in PERSONAL.items()) + ") GROUP BY kind",
    "pii_spans": "SELECT doc_id, kind, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start, m[i] AS found FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b FROM documents WHERE regexp_matches(text, '{p}')" for k, p in PERSONAL.items()) + "))",
    "protected_spans": _with("lines", "SELECT kind, count(*) AS n, sum(start) AS starts FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(length(regexp_split_to_array(text, '{p}')[1]) AS BIGINT) AS start FROM lines WHERE regexp_matches(text, '{p}')" for k, p in PROTECTED.items()) + ") GROUP BY kind"),
    "masked_documents": f"SELECT doc_id, md5({_mask}) AS masked_md5 FROM documents",
    "overlap_join": _with("lines", "SELECT a.doc, count(*) AS n FROM lines a JOIN lines b ON a.doc = b.doc AND a.page = b.page AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1 + 10, b.y1) > greatest(a.y0, b.y0) GROUP BY a.doc"),
    "mask_conflicts": _with("lines", "SELECT a.doc, a.line_no AS box_id, string_agg(DISTINCT 'k' || b.line_no, ',' ORDER BY 'k' || b.line_no) AS kinds FROM lines a JOIN lines b ON a.doc = b.doc AND a.page = b.page AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1 + 10, b.y1) - greatest(a.y0, b.y0), 0) > 0.15 * (b.x1 - b.x0) * (b.y1 - b.y0) GROUP BY ALL"),
    "clean_boxes": _with("lines", "SELECT doc, line_no, greatest(x0, 0) AS x0, least(x1, 60) AS x1, greatest(y0, 0) AS y0, least(y1, 110) AS y1, CASE WHEN line_no % 2 = 0 THEN 'auto' ELSE 'manual' END AS kind FROM lines WHERE least(x1, 60) - x0 >= 2 AND least(y1, 110) - y0 >= 2"),
    "page_warnings": _with("lines", "SELECT warnings, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN sum(length(text)) < 20 THEN 'no_text_layer' END, CASE WHEN avg(confidence) < 75 THEN 'low_confidence' END) AS warnings FROM lines GROUP BY doc, page) WHERE warnings <> '' GROUP BY warnings"),
    "release_ready": "SELECT reason IS NULL AS ready, reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'source_changed' WHEN o_orderkey % 4 = 0 THEN 'not_approved' WHEN o_orderkey % 3 > 0 THEN 'unresolved' END AS reason FROM orders) GROUP BY reason",
    "manifest_upsert": "SELECT o_custkey AS doc, max(o_orderkey) AS exported_at, CAST(max(o_orderkey) AS VARCHAR) AS hash FROM orders GROUP BY o_custkey",
    "page_plan_audit": _with("facts", "p AS (SELECT doc, coalesce(list(batch ORDER BY batch) FILTER (batch < 3), []) AS p, bool_or(batch = 3) AS o FROM facts GROUP BY doc)", "SELECT doc, problems FROM (SELECT doc, concat_ws(',', CASE WHEN len(p) <> len(list_distinct(p)) THEN 'order' END, CASE WHEN len(p) + CAST(o AS INT) <> 3 THEN 'sum' END) AS problems FROM p) WHERE problems <> ''"),
    "key_conflicts": _with("facts", "SELECT doc, 2 AS n_keys FROM facts GROUP BY doc HAVING bool_or(batch < 3) AND bool_or(batch >= 2)"),
    "oversize_records": """SELECT doc_id, bytes FROM (SELECT doc_id, strlen('{"doc_id":,"lang":"","source":"","n_chars":}' || doc_id || coalesce(lang, 'ul') || coalesce(source, 'ul') || n_chars) AS bytes FROM documents) WHERE bytes > 54""",
    "pending_rules": "SELECT n_name AS rule_id, CASE n_nationkey % 3 WHEN 1 THEN 'open' END AS verification FROM nation WHERE n_nationkey % 3 <> 0",
    "log_field_audit": "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'device')), ',') AS extra FROM events WHERE len(list_filter(json_keys(props), lambda k: k <> 'device')) > 0",
    "upload_dedup": "SELECT event_id, user_id AS job FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "admissions": "WITH a AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS own FROM events), b AS (SELECT event_id, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS r FROM a WHERE own <= 2) SELECT event_id, coalesce(b.r <= 200, false) AS admitted FROM a LEFT JOIN b USING (event_id)",
    "alarm_windows": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
    "review_revisions": "WITH c AS (SELECT event_id, user_id AS job, ts, floor(value / 40) AS v FROM events), d AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM c WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)) SELECT event_id, job, CAST(sum(c) OVER (PARTITION BY job ORDER BY ts, event_id) AS BIGINT) AS revision FROM d",
    "read_budget": "SELECT r <= 4 AS allowed, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1",
    "typed_sessions": "WITH a AS (SELECT user_id AS job, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '900 seconds' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT job, min(ts) AS session_start, count(*) AS n FROM b GROUP BY job, s",
    "retained_jobs": "SELECT event_type AS kind, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1",
    "failure_outcomes": "SELECT CASE WHEN event_type = 'error' THEN 'retry' ELSE 'final' END AS outcome, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
}

_rows = 'p AS (SELECT doc, r_no AS "row", max(CASE col WHEN 1 THEN text END) AS d, max(CASE col WHEN 2 THEN text END) AS q, max(CASE col WHEN 3 THEN text END) AS r, max(CASE col WHEN 4 THEN text END) AS m, max(CASE col WHEN 5 THEN text END) AS a FROM cells WHERE r_no > 1 GROUP BY ALL HAVING min(confidence) >= 50)'
_key = "CASE WHEN text LIKE 'Grand total %' THEN 'total' WHEN text LIKE 'GST amount %' THEN 'gst' WHEN text LIKE 'No. of modules: %' THEN 'count' ELSE 'unkeyed' END"

ORACLES |= {
    "option_rows": _with("offers", """o AS (SELECT doc, r_no AS "row", 1000 * CAST(regexp_extract(max(CASE col WHEN 2 THEN text END), '([0-9]+)', 1) AS BIGINT) AS capacity, CAST(regexp_extract(max(CASE col WHEN 3 THEN text END), '([0-9]+)', 1) AS BIGINT) AS amount FROM offers WHERE r_no > 1 GROUP BY ALL)""", "SELECT * FROM o WHERE doc IN (SELECT doc FROM o GROUP BY doc HAVING count(*) >= 2 AND count(*) = count(DISTINCT capacity))"),
    "bom_rows": _with("cells", _rows, """SELECT doc, "row", CASE WHEN d = 'String inverter' THEN 'inverter' ELSE 'panel' END AS item, CASE WHEN q NOT LIKE '%sets' AND CAST(split_part(q, ' ', 1) AS INT) >= 2 THEN CAST(split_part(q, ' ', 1) AS INT) END AS count, CAST(split_part(r, ' ', 1) AS BIGINT) * CASE WHEN r LIKE '%kW' THEN 1000 ELSE 1 END AS rating, m AS make FROM p WHERE d IN ('Solar PV modules', 'String inverter')"""),
    "amount_rows": _with("cells", _rows, """SELECT doc, "row", CASE d WHEN 'Base price' THEN 'base_price' ELSE 'gross_total' END AS role, CAST(regexp_extract(a, '([0-9]+)', 1) AS BIGINT) AS amount FROM p WHERE d IN ('Base price', 'Total including GST')"""),
    "evidence_boxes": _with("lines", "SELECT a.doc, a.line_no AS fact_id, CAST(count(*) AS INT) AS n FROM lines a JOIN lines b ON a.doc = b.doc AND a.page = b.page AND a.text = b.text GROUP BY ALL"),
    "typed_holds": _with(_all, *VIEW, *GUARDS, "w AS (SELECT DISTINCT quote_id FROM g WHERE field IN ('base', 'gst', 'total', 'discount'))", f"c AS (SELECT quote_id, {_split} FROM (SELECT quote_id, {C3A} AS o FROM v))", "SELECT quote_id, CASE WHEN h THEN 'needs_confirmation' ELSE status END AS status, CASE WHEN h THEN 'check_entry' ELSE question END AS question FROM (SELECT *, status IN ('consistent', 'inconsistent') AND quote_id IN (SELECT quote_id FROM w) AS h FROM c)"),
    "message_keys": _with("lines", f"SELECT doc * 10 + line_no AS id, CASE WHEN line_no < 3 THEN 'C3' ELSE 'C4' END AS check_id, {_key} AS key FROM lines"),
    "message_texts": _with("lines", f"k AS (SELECT doc * 10 + line_no AS id, {_key} AS key, regexp_extract(text, '([0-9]+)', 1) AS n FROM lines)", "SELECT id, key, CASE key WHEN 'count' THEN n || ' Module' WHEN 'gst' THEN 'Steuer von ' || n ELSE 'Total of ' || n END AS text, key = 'total' AS fallback FROM k WHERE key <> 'unkeyed'"),
    "labelled_quotes": _with("items", "SELECT quote_id AS doc, CAST(row_number() OVER (PARTITION BY quote_id ORDER BY item_id) AS INT) AS nth, n AS count, CASE WHEN watt_lo = watt_hi THEN watt_lo END AS watts, make FROM items QUALIFY n IS NOT NULL OR watt_lo = watt_hi OR make IS NOT NULL"),
    "wrong_operands": _with("quotes", "SELECT quote_id AS doc, 'C3a' AS check_id, operand, used, used + 1 AS stated FROM (SELECT quote_id, 'base' AS operand, base AS used FROM quotes UNION ALL SELECT quote_id, 'total', total FROM quotes) WHERE quote_id % 4 = 0 AND used IS NOT NULL"),
    "record_problems": "WITH d AS (SELECT *, doc_id % 5 NOT IN (1, 2, 3) AS off FROM documents) SELECT doc_id AS key, 'lang' AS path, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'missing' ELSE 'value' END AS problem FROM d WHERE lang IS NULL OR trim(lang) NOT IN ('en', 'de', 'fr') UNION ALL SELECT doc_id, 'source', 'missing' FROM d WHERE source IS NULL OR trim(source) = '' UNION ALL SELECT doc_id, 'lang', 'page' FROM d WHERE off AND trim(lang) <> '' UNION ALL SELECT doc_id, 'source', 'page' FROM d WHERE off AND trim(source) <> '' UNION ALL SELECT doc_id, 'n_chars', 'page' FROM d WHERE off AND n_chars IS NOT NULL UNION ALL SELECT doc_id, 'extra', 'unknown' FROM d WHERE doc_id % 7 = 0",
    "form_corrections": _with("answers", "SELECT quote_id AS key, 'site.state' AS path, state AS value FROM answers WHERE state IS NOT NULL UNION ALL SELECT quote_id, 'customer.type', consumer FROM answers WHERE consumer IS NOT NULL"),
    "label_values": _with("lines", "SELECT a.doc, a.page, a.line_no AS label_no, CAST(min(b.line_no) AS BIGINT) AS line_no, 'below' AS place FROM lines a JOIN lines b ON a.doc = b.doc AND a.page = b.page AND a.line_no IN (3, 4) AND b.y0 >= a.y1 AND b.y0 - a.y1 <= 1.2 * (a.y1 - a.y0) AND b.x0 < a.x1 AND b.x1 > a.x0 GROUP BY ALL"),
}

_none = "CAST(NULL AS VARCHAR)"
ORACLES |= {
    "expired_records": "SELECT record, expired, count(*) AS n FROM (SELECT record, CASE record WHEN 'job' THEN ts < TIMESTAMP '2024-01-05' WHEN 'upload' THEN ts < TIMESTAMP '2024-01-05' WHEN 'counter' THEN ts < TIMESTAMP '2024-01-04' WHEN 'log' THEN ts < TIMESTAMP '2023-12-30' ELSE false END AS expired FROM (SELECT ts, ['job', 'counter', 'upload', 'log', 'other'][user_id % 5 + 1] AS record FROM events) a) b GROUP BY ALL",
    "slot_provenance": _with("facts", "a AS (SELECT doc, field AS slot, 'line ' || pos % 2 AS evidence, value, pos, rule, confidence FROM facts)", "x AS (SELECT DISTINCT doc, slot, evidence, CASE WHEN pos % 5 <> 0 THEN value END AS v FROM a)", "y AS (SELECT doc, slot, evidence, rule, confidence, CASE WHEN pos % 7 <> 0 THEN value END AS c FROM a WHERE rule <> 'unmatched')",
        "SELECT doc, slot, evidence, CASE WHEN v IS NOT NULL THEN 'No ' || v END AS raw, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), 'unmatched') AS rules, min(confidence) AS confidence FROM x LEFT JOIN y USING (doc, slot, evidence) WHERE rule IS NULL OR v IS NULL OR c IS NULL OR v = c GROUP BY ALL UNION ALL SELECT doc, slot, evidence, 'No ' || v, 'unmatched', NULL FROM x WHERE EXISTS (SELECT 1 FROM y WHERE y.doc = x.doc AND y.slot = x.slot AND y.evidence = x.evidence) AND NOT EXISTS (SELECT 1 FROM y WHERE y.doc = x.doc AND y.slot = x.slot AND y.evidence = x.evidence AND (x.v IS NULL OR y.c IS NULL OR x.v = y.c))"),
    "extract_pages": f"""WITH l AS (SELECT doc, field, value, 'line' AS rule FROM ({ORACLES['line_candidates']}) a UNION ALL SELECT doc, role, CAST(amount AS VARCHAR), 'table' FROM ({ORACLES['amount_rows']}) b),
  k AS (SELECT doc, field, count(DISTINCT value) > 1 AS c FROM l GROUP BY ALL), b AS ({ORACLES['bom_rows']}), o AS ({ORACLES['option_rows']})
  SELECT l.doc, {_none} AS "option", {_none} AS list, {_none} AS item, l.field, l.value, l.rule, k.c AS conflict FROM l JOIN k USING (doc, field)
  UNION ALL SELECT doc, {_none}, CASE item WHEN 'panel' THEN 'module_groups' ELSE 'inverters' END, '1/' || "row", f, v, 'table', false FROM (SELECT doc, item, "row", unnest(['count', CASE item WHEN 'panel' THEN 'wattage' ELSE 'rating' END, 'make_model']) AS f, unnest([CAST(count AS VARCHAR), CAST(rating AS VARCHAR), make]) AS v FROM b) c WHERE v <> ''
  UNION ALL SELECT doc, '2/' || "row", {_none}, {_none}, f, v, 'table', false FROM (SELECT doc, "row", unnest(['system_size', 'gross_total']) AS f, unnest([CAST(capacity AS VARCHAR), CAST(amount AS VARCHAR)]) AS v FROM o) d""",
    "score_special": _with("quotes charges", "r AS (SELECT quote_id AS doc, unnest(['subsidy', 'subsidy_type', 'vendor_name', 'dcr_text']) AS field, central FROM quotes UNION ALL SELECT DISTINCT quote_id, 'extra_charges_outside_total', 1 FROM charges WHERE placed = 'outside' AND amount IS NOT NULL)",
        "SELECT doc, field, CASE WHEN field IN ('subsidy', 'subsidy_type') AND central IS NULL THEN 'abstained' WHEN field = 'subsidy_type' AND doc % 5 = 1 THEN 'missing' WHEN doc % 10 = 0 THEN 'conflict_flagged' WHEN field = 'subsidy' AND doc % 4 = 0 OR field = 'vendor_name' AND doc % 3 = 2 OR field = 'dcr_text' AND doc % 3 = 0 OR field = 'extra_charges_outside_total' AND doc % 4 = 1 THEN 'wrong' ELSE 'correct' END AS status FROM r"),
    "stored_sizes": "SELECT doc_id, CAST(3 + 6 + 1 + length(CAST(doc_id AS VARCHAR)) + 1 + 4 + 1 + coalesce(strlen(lang), 1) + 6 + 1 + coalesce(strlen(source), 1) + 7 + 1 + coalesce(length(CAST(n_chars AS VARCHAR)) + 1, 1) + 4 + 1 + coalesce(strlen(text), 1) AS BIGINT) AS bytes FROM documents",
    "kept_readings": "SELECT doc_id AS batch, coalesce(length(text) <= 600, true) AND coalesce(sum(strlen(text)) FILTER (length(text) <= 600) OVER (PARTITION BY doc_id % 97), 0) <= 3000 AS kept FROM documents",
}

# What each line says, read by a person: role, whether it is denied, a if it has one amount, n or w for its one count and measure (k: n kilowatts), d for a date of the quotation.
LABELS = {
    "Grand total Rs. {a}/-": "gross_total a", "Total cost (incl. GST) Rs {a}": "gross_total a", "Amount payable: {a}": "gross_total a", "Total before subsidy Rs {a}": "gross_total a", "Cost without state subsidy ₹ {a}": "gross_total a", "Price prior to the CFA INR {a}": "gross_total a",
    "Basic price Rs {a}": "base_price a", "Base cost {a}": "base_price a", "Sub-total {a}": "base_price a", "Subtotal: Rs. {a}": "base_price a", "Taxable value Rs {a}": "base_price a", "Price excluding GST Rs {a}": "base_price a", "Amount exclusive of GST {a}": "base_price a", "Cost before GST Rs {a}": "base_price a",
    "CGST 9% Rs {a}": "gst_amount a", "GST @ 8.9% {a}": "gst_amount a", "IGST Rs {a} only": "gst_amount a", "GST (included in Grand Total) Rs {a}": "gst_amount a", "GST not included in total Rs {a}": "gst_amount denied a",
    "Net cost Rs {a}": "net_cost a", "Net payable after central subsidy {a}": "net_cost a", "Effective price ₹{a}": "net_cost a", "Post-subsidy amount Rs {a}": "net_cost a", "Cost after the CFA Rs {a}": "net_cost a", "Net cost before subsidy Rs {a}": "a",
    "Central subsidy (CFA) Rs. {a}": "subsidy a", "MNRE amount: {a}": "subsidy a", "No subsidy": "denied", "Subsidy not applicable Rs {a}": "denied a", "Meter by the customer Rs {a}": "denied a", "Cable in client's scope {a}": "denied a", "Structure (optional) Rs {a}": "denied a", "Civil work: Nil": "denied",
    "Total GST Rs {a}": "a", "Total Rs {a} or Rs {a}": "gross_total", "GST 18% on Rs {a}": "gst_amount", "18 percent of Rs {a}": "", "Rate @ {a}": "", "No. of modules: {n}": "panel n", "Number of panels - {n}": "panel n", "Solar modules, Qty {n}": "panel n", "{n} nos panels of {w} Wp": "panel n w", "PV panels {n} sets": "",
    "System size {n} kWp": "size k", "Plant capacity {n} kW or {n}000 W": "", "Project capacity {n} - 12 kW": "", "Inverter rating {n} kW": "k", "Quotation date 0{n}/10/2026": "d", "Valid till 0{n}/10/2026": "", "Structure and cables": "",
}
_roles = ("gross_total", "base_price", "gst_amount", "net_cost", "subsidy")
_label_rows = ", ".join(f"({i}, " + (f"'{r[0]}'" if (r := [x for x in _roles if x in LABELS[t].split()]) else "NULL") + "".join(f", {str(x in LABELS[t].split()).lower()}" for x in ("denied", "a", "n", "w", "k", "d", "panel", "size")) + ")" for i, t in enumerate(SHAPES))
_labels = f"label(shape, role, no, has_a, has_n, has_w, has_k, has_d, of_panel, of_size) AS (VALUES {_label_rows})"
_date = "'0' || CAST(n AS VARCHAR) || '/10/2026'"
ORACLES["phrase_readings"] = _with("phrases", _labels, f"SELECT doc, line_no, role, no AS denied, CASE WHEN has_a THEN a END AS amount, CASE WHEN has_n THEN CAST(n AS INT) END AS count, CASE WHEN has_w THEN w WHEN has_k THEN 1000 * n END AS measure, CASE WHEN has_d THEN {_date} END AS date FROM phrases JOIN label USING (shape)")
ORACLES["phrase_candidates"] = _with("phrases", _labels, " UNION ALL ".join(f"SELECT doc, line_no, {f} AS field, CAST({v} AS VARCHAR) AS value FROM phrases JOIN label USING (shape) WHERE NOT no AND {when}" for f, v, when in (
    ("role", "a", "role IS NOT NULL AND has_a"), ("'panel_count'", "n", "of_panel AND has_n"), ("'panel_wattage'", "w", "of_panel AND has_w"), ("'system_size'", "1000 * n", "of_size AND has_k"), ("'quote_date'", _date, "has_d"))))

_term_rows = (
    r"words AS (SELECT item_id, list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1, 3) AS w FROM benchmark)",
    "term AS (SELECT DISTINCT CASE WHEN item_id % 2 = 1 THEN 'keep' ELSE 'deny' END AS kind, array_to_string(w, ' ') AS term, ' ' || lower(array_to_string(w, '  ')) || ' ' AS shape FROM words WHERE len(w) > 0)",
    r"""apart AS (SELECT doc_id, text, '  ' || regexp_replace(regexp_replace(lower(text), '([^\p{L}\p{N}_\s,.])', ' \1 ', 'g'), '[\s,.]+', '  ', 'g') || '  ' AS t FROM documents WHERE text IS NOT NULL)""",
    "found AS (SELECT doc_id, kind, term, CAST((length(t) - length(replace(t, shape, ''))) / length(shape) AS BIGINT) AS n FROM apart JOIN term ON contains(t, shape))",
)
ORACLES["term_spans"] = _with("", *_term_rows, "SELECT doc_id, kind, term, n FROM found")
_any_personal = " OR ".join(f"regexp_matches(text, '{p}')" for p in PERSONAL.values())
ORACLES["mask_audit"] = _with("", *_term_rows, f"SELECT count(*) AS n_texts, count_if({_any_personal} OR doc_id IN (SELECT doc_id FROM found WHERE kind = 'deny')) AS n_masked, 0 AS n_survivors FROM apart")
_all_spans = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in [*PERSONAL.values(), *PROTECTED.values()])
ORACLES["pii_in_conversations"] = f"SELECT conv_id, count(text) AS n_texts, CAST(coalesce(sum({_all_spans}), 0) AS BIGINT) AS n_spans FROM conversations GROUP BY conv_id"

ORACLES["answer_gate_boxes"] = _with("phrases", _labels, """SELECT doc, line_no AS answer_id, why, why IS NULL AS kept FROM (SELECT doc, line_no, CASE WHEN 40 + a % 60 < 50 THEN 'low_confidence' WHEN a % 7 = 0 THEN 'unparsed' WHEN a % 7 = 1 OR NOT contains(text, CAST(a AS VARCHAR)) THEN 'not_on_page'
  WHEN no THEN 'negated' WHEN NOT has_a AND text NOT LIKE 'Total Rs % or Rs %' THEN 'not_an_amount_on_its_line' END AS why FROM phrases JOIN label USING (shape))""")
_paths = (
    "m AS (SELECT doc, CASE field WHEN 'base' THEN 'base_price' WHEN 'gst' THEN 'gst_amount' WHEN 'total' THEN 'gross_total' ELSE 'net_cost' END AS field, CASE WHEN count(DISTINCT value) = 1 AND NOT bool_or(flagged) THEN min(value) END AS value FROM facts GROUP BY ALL)",
    "docs AS (SELECT DISTINCT doc FROM facts)",
)
ORACLES["corrected_facts"] = _with("facts", *_paths, """e AS (SELECT doc, doc % 3 = 0 AND doc % 4 <> 0 AS hit FROM docs), all_ AS (
  SELECT doc, NULL AS option, NULL AS list, NULL AS item, field, CASE WHEN field = 'gross_total' AND hit THEN '9' ELSE value END AS value, CASE WHEN field = 'gross_total' AND hit THEN value END AS original, field = 'gross_total' AND hit AS corrected FROM m JOIN e USING (doc)
  UNION ALL SELECT doc, NULL, NULL, NULL, 'gross_total', '9', NULL, true FROM e WHERE hit AND doc NOT IN (SELECT doc FROM m WHERE field = 'gross_total')
  UNION ALL SELECT doc, 'A', NULL, NULL, 'gross_total', CASE WHEN doc % 3 = 0 THEN '9' ELSE '7' END, CASE WHEN doc % 3 = 0 THEN '7' END, doc % 3 = 0 FROM docs WHERE doc % 4 = 0
  UNION ALL SELECT doc, NULL, 'module_groups', 'G1', 'count', CAST(doc % 5 AS VARCHAR), NULL, false FROM docs
  UNION ALL SELECT doc, NULL, 'module_groups', 'G1', 'wattage', '550 W', NULL, true FROM docs WHERE doc % 5 = 0
  UNION ALL SELECT doc, CASE WHEN doc % 2 = 0 THEN 'A' END, 'extra_charges', 'U2', 'amount', '100', NULL, true FROM docs WHERE doc % 7 = 0)""", "SELECT * FROM all_")
ORACLES["correction_errors"] = _with("facts", *_paths, "SELECT doc, 'module_groups[G9].count' AS path, 'unknown_item' AS reason FROM docs WHERE doc % 11 = 0 UNION ALL SELECT doc, 'nothing', 'unknown_path' FROM docs WHERE doc % 13 = 0")
ORACLES["loose_bindings"] = _with("facts", "r AS (SELECT doc, pos % 4 AS item, field, value FROM facts WHERE batch = 1)", "l AS (SELECT doc, field, pos AS nth, value FROM facts WHERE batch <> 1)",
    "i AS (SELECT doc, count(DISTINCT item) AS n_items, min(item) AS only_one FROM r GROUP BY doc)", "apart AS (SELECT DISTINCT l.doc, l.field, l.value FROM l JOIN i USING (doc) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND r.field = l.field AND r.value = l.value))",
    """b AS (SELECT doc, item, field, 'row' AS binding FROM r UNION ALL SELECT a.doc, x.item, a.field, 'conflict' FROM apart a JOIN (SELECT DISTINCT doc, item, field FROM r) x ON x.doc = a.doc AND x.field = a.field
    UNION ALL SELECT doc, only_one, field, CASE WHEN count(*) OVER (PARTITION BY doc, field) > 1 THEN 'conflict' ELSE 'filled' END FROM apart a JOIN i USING (doc) WHERE n_items = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc = a.doc AND r.field = a.field)
    UNION ALL SELECT doc, nth, field, 'paired' FROM l WHERE doc NOT IN (SELECT doc FROM i))""", "SELECT doc, item, field, binding, count(*) AS n FROM b GROUP BY ALL")  # fmt: skip
ORACLES["measured_merge"] = _with("facts", "SELECT doc, field, count(DISTINCT value) > 1 OR bool_or(flagged) AS conflict, CAST(count(DISTINCT value) AS INT) AS n_values FROM facts GROUP BY doc, field")
_or0 = lambda x: f"coalesce(CAST({x} AS DOUBLE), 0)"
ORACLES["recheck_agreement"] = _with("quotes items charges", "w AS (SELECT quote_id, sum(n * watt_lo) AS watts FROM items GROUP BY quote_id)", "c AS (SELECT quote_id, sum(amount) AS inside FROM charges WHERE placed = 'inside' GROUP BY quote_id)",
    f"""t AS (SELECT quote_id, abs({_or0('watts')} / 1000 - {_or0('stated_kw')}) <= 0.01 + 1e-9 AS c1, abs(CASE WHEN stated_kw IS NULL THEN 0 ELSE 30000 * least({_or0('stated_kw')}, 2) + 18000 * greatest(0, least({_or0('stated_kw')}, 3) - 2) END - {_or0('central')}) <= 1 + 1e-9 AS c2,
    abs({_or0('base')} + {_or0('gst')} + {_or0('inside')} - {_or0('discount')} - {_or0('total')}) <= 1 + 1e-9 AS c3a, abs({_or0('total')} - {_or0('central')} - {_or0('state_subsidy')} - {_or0('combined')} - {_or0('net')}) <= 1 + 1e-9 AS c3b,
    stated_kw IS NOT NULL OR watts IS NOT NULL AS h1, stated_kw IS NOT NULL OR central IS NOT NULL AS h2, coalesce(base, gst, inside, discount, total) IS NOT NULL AS h3, coalesce(total, central, state_subsidy, combined, net) IS NOT NULL AS h4 FROM quotes LEFT JOIN w USING (quote_id) LEFT JOIN c USING (quote_id))""",
    "f AS (SELECT quote_id, unnest(['C1', 'C2_general', 'C3a', 'C3b']) AS \"check\", unnest([c1, c2, c3a, c3b]) AS holds, unnest([h1, h2, h3, h4]) AS has FROM t)",
    "SELECT quote_id % 3 AS \"set\", \"check\", count_if(has AND holds = (quote_id % 4 <> 0)) AS n_agree, count_if(has AND holds <> (quote_id % 4 <> 0)) AS n_disagree FROM f GROUP BY ALL")
ORACLES["row_evidence"] = _with("cells", "r AS (SELECT doc, page, r_no, string_agg(trim(text), ' | ' ORDER BY col) AS t FROM cells GROUP BY ALL)", "SELECT a.doc, a.r_no AS fact_id, CAST(count(*) AS INT) AS n FROM r a JOIN r b ON a.doc = b.doc AND a.page = b.page AND a.t = b.t GROUP BY ALL")
ORACLES["complete_jobs"] = """WITH n AS (SELECT doc_id % 50 AS job, doc_id // 50 % 5 + 1 AS batch, max(doc_id) AS id FROM documents GROUP BY ALL),
r AS (SELECT n.*, CASE WHEN id % 11 = 0 THEN 'old' ELSE 'new' END AS model, lang AS value FROM n JOIN documents ON doc_id = id),
p AS (SELECT job, arg_max(model, id) AS plan FROM r GROUP BY job)
SELECT job, string_agg(coalesce(value, '-'), ',' ORDER BY batch) AS "values" FROM r JOIN p USING (job) WHERE model = plan AND batch <= 5 - job % 2 GROUP BY job HAVING count(*) = 5 - job % 2"""
