"""The registered queries once more as ANSI SQL, written for a second engine to check the results.

A statement is a chain of common table expressions (scripts, lexemes, tokens, neighbours, brackets, ...)
and a final select.
"""

from __future__ import annotations

from lexframe.functions import adjacency as A
from lexframe.functions import patterns as P
from lexframe.operators import rules as R
from lexframe.operators import structure as S
from lexframe.operators.logs import CATEGORIES, LAZY_LINE, STRICT_LINE
from lexframe.sources import corpus as C
from lexframe.sources import snippets as N


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rx(pattern: str) -> str:
    return q(P.plain(pattern))


# --- templates: this engine has no helper, so its patterns nest to a fixed depth, deep enough for the supplied tables ---

TEMPLATE_DEPTH, BRACE_DEPTH = 3, 2
_END = r"(?:\$++\{|\$*+`)"


def _template_body(depth: int, braces: int) -> str:
    inner = f"|{_template(depth - 1)}" if depth > 1 else ""
    nested = rf"|\{{{_template_body(depth, braces - 1)}\}}" if braces > 0 else ""
    return rf"(?:[^`\"'{{}}/\\\x03]++|\\[^\x03]|{P._DQ}\"|{P._SQ}'|{P.COMMENT}|/{nested}{inner})*+"


def _template(depth: int) -> str:
    return r"`(?:[^`\\$\x03]++|\\[^\x03]|\$++(?:[^{`\\$\x03]|\\[^\x03]|\{" + _template_body(depth, BRACE_DEPTH) + r"\}))*+\$*+`"


_LEXEME = P.LEXEME.replace(rf"`{P.TEMPLATE_CHARS}\$*+`", _template(TEMPLATE_DEPTH))
_BODY_LEXEME = P.BODY_LEXEME.replace(rf"`{P.TEMPLATE_CHARS}\$*+`", _template(TEMPLATE_DEPTH))
_UNIT = rf"({_template_body(TEMPLATE_DEPTH, BRACE_DEPTH)})(\}}{P.TEMPLATE_CHARS}{_END})"
_PARTS = rf"\A{P.TRIVIA}`{P.TEMPLATE_CHARS}{_END}|{_template_body(TEMPLATE_DEPTH, BRACE_DEPTH)}\}}{P.TEMPLATE_CHARS}{_END}"


# --- corpora ---------------------------------------------------------------------------------------------


def _generated() -> str:
    src = f"[{', '.join(q(s) for s in N.ALL)}][cast(o_orderkey % {N.COUNT} as int) + 1]"
    for mark, value in C.placeholder_values().items():
        src = f"replace({src}, '@{mark}', {value})"
    return f"select 'o' || cast(o_orderkey as varchar) as script_id, {C.path_of_key('o_orderkey')} as path, {src} as src from orders"


_PAGES = r"""select 'p:' || cast(page_id as varchar) || ':' || cast(n as varchar) as script_id, url || '#' || cast(n as varchar) || '.js' as path, src
 from (select page_id, url, unnest(bodies) as src, generate_subscripts(bodies, 1) - 1 as n
       from (select page_id, url, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) as bodies from pages))"""
_PROSE = (
    "select 'd' || cast(doc_id as varchar) as script_id, source || '/' || cast(doc_id as varchar) || '.txt' as path, text as src from documents"
)
_CORPORA = {"gen": [_generated()], "pages": [_PAGES], "code": [_generated(), _PAGES], "all": [_generated(), _PAGES, _PROSE]}


def scripts(corpus: str) -> str:
    union = " union all ".join(_CORPORA[corpus])
    return (
        "scripts as (select script_id, path, regexp_extract(path, '\\.[^.]*$') as ext, length(src) as size, src "
        f"from ({union}))"
    )


# --- tokens ----------------------------------------------------------------------------------------------


def _split_heads(lx: str) -> str:
    split = rx(P.SPLIT_HEAD)
    return (
        f"flatten(list_transform({lx}, lambda x: case when contains(x, '/') and regexp_matches(x, {split}) "
        f"then [regexp_extract(x, {split}, 1), regexp_extract(x, {split}, 2)] else [x] end))"
    )


def _expand(lx: str) -> str:
    unit = rx(rf"\A{_UNIT}\z")
    body = _split_heads(f"regexp_extract_all(regexp_extract(u, {unit}, 1), {rx(_BODY_LEXEME)})")
    merged = f"""list_transform([{{'b': {body}, 's': regexp_extract(u, {unit}, 2)}}], lambda p:
        case when len(p.b) > 0 and regexp_matches(p.b[-1], {rx(P.ONLY_TRIVIA)})
             then p.b[:len(p.b) - 1] || [p.b[-1] || p.s] else p.b || [p.s] end)[1]"""
    parts = f"regexp_extract_all(e, {rx(_PARTS)})"
    return f"""flatten(list_transform({lx}, lambda e:
        case when ends_with(e, '`') and contains(e, '${{') and regexp_matches(e, {rx(rf"\A{P.TRIVIA}`")}) and len({parts}) > 0
             then [{parts}[1]] || flatten(list_transform({parts}[2:], lambda u: {merged})) else [e] end))"""


_KIND = f"""case when text = chr(3) then 'EOF'
    when text in {in_list(P.KEYWORDS + P.WORD_LITERALS)} then upper(text)
    when text in {in_list(P.OPERATORS + P.DELIMITERS)} then text
    when regexp_matches(text, '^[A-Za-z$_]') or (text[1] = '\\' and length(text) > 1) then 'IDENTIFIER'
    when regexp_matches(text, '^[0-9.]') then 'NUMBER'
    when text[1] in ('"', '''') then 'STRING'
    when text[1] = '`' and length(text) > 1 then case when ends_with(text, '`') then 'TEMPLATE_NO_SUB' else 'TEMPLATE_HEAD' end
    when text[1] = '}}' then case when ends_with(text, '`') then 'TEMPLATE_TAIL' else 'TEMPLATE_MIDDLE' end
    when text[1] = '/' then 'REGEX' else 'ERROR' end"""
_FAMILY = f"""case when kind in {in_list([k.upper() for k in P.KEYWORDS])} then 'keyword'
    when kind in {in_list([k.upper() for k in P.WORD_LITERALS] + ['NUMBER', 'STRING', 'REGEX'])} then 'literal'
    when kind = 'IDENTIFIER' then 'identifier' when starts_with(kind, 'TEMPLATE') then 'template'
    when kind in {in_list(P.OPERATORS)} then 'operator' when kind in {in_list(P.DELIMITERS)} then 'delimiter' else 'special' end"""


def tokens() -> list[str]:
    rounds, lx = [], "lx"
    src = "(replace(src, chr(3), '�') || chr(10) || chr(3))"
    ctes = [
        f"lex0 as (select script_id, contains(src, '${{') as subs, {_split_heads(f'regexp_extract_all({src}, {rx(_LEXEME)})')} as lx from scripts)"
    ]
    for i in range(TEMPLATE_DEPTH):
        ctes.append(f"lex{i + 1} as (select script_id, subs, case when subs then {_expand('lx')} else lx end as lx from lex{i})")
    ctes.append(
        f"raws as (select script_id, unnest(lx) as raw, generate_subscripts(lx, 1) - 1 as pos from lex{TEMPLATE_DEPTH})"
    )
    ctes.append(
        f"texts as (select script_id, cast(pos as int) as pos, raw, regexp_replace(raw, {rx(P.LEADING_TRIVIA)}, '') as text from raws)"
    )
    ctes.append(
        f"tok as materialized (select *, {_FAMILY} as family from (select *, {_KIND} as kind, "
        "contains(left(raw, length(raw) - length(text)), chr(10)) as newline_before from texts))"
    )
    return ctes


#: Offsets from the text before each token.
POSITIONS = """placed as (
 select *, length(before) as off, cast(length(before) - length(replace(before, chr(10), '')) + 1 as int) as line,
   case when contains(before, chr(10)) then instr(reverse(before), chr(10)) else length(before) + 1 end as col
 from (select *, string_agg(raw, '') over (partition by script_id order by pos) as upto,
   left(upto, length(upto) - length(text)) as before from tok))"""
#: The same from running sums, for long scripts.
POSITIONS_SUM = """ends as (
 select *, sum(length(raw)) over w as stop, sum(length(raw) - length(replace(raw, chr(10), ''))) over w as breaks
 from tok window w as (partition by script_id order by pos)),
lines as (select *, max(case when contains(raw, chr(10)) then stop - instr(reverse(raw), chr(10)) + 1 end) over
   (partition by script_id order by pos rows between unbounded preceding and 1 preceding) as last_break,
   left(raw, length(raw) - length(text)) as lead_text from ends),
placed as (select *, cast(stop - length(text) as int) as off,
   cast(breaks - (length(text) - length(replace(text, chr(10), ''))) + 1 as int) as line,
   cast(case when contains(lead_text, chr(10)) then instr(reverse(lead_text), chr(10))
        else stop - length(text) - coalesce(last_break, 0) + 1 end as int) as col from lines)"""

# --- structure --------------------------------------------------------------------------------------------


def neighbours(source: str = "tok") -> str:
    cols = []
    for i in range(1, 6):
        cols += [f"lag(kind, {i}) over w as p{i}", f"lag(text, {i}) over w as p{i}t"]
    for i in range(1, 6):
        cols += [f"lead(kind, {i}) over w as n{i}", f"lead(text, {i}) over w as n{i}t"]
    for name, o, c in [("paren", "(", ")"), ("brace", "{", "}"), ("bracket", "[", "]")]:
        cols.append(f"cast(sum(case kind when '{o}' then 1 when '{c}' then -1 else 0 end) over w as int) as {name}_depth")
    opens, closes = in_list(S.OPENERS), in_list(S.CLOSERS)
    cols.append(
        f"cast(sum(case when kind in {opens} then 1 when kind in {closes} then -1 else 0 end) over w as int) as depth"
    )
    return f"""nb as (select *, depth + case when is_close then 1 else 0 end as level from (
        select *, kind in {opens} as is_open, kind in {closes} as is_close, {', '.join(cols)}
        from {source} window w as (partition by script_id order by pos)))"""


_FUNCTION = f"coalesce(p1 = 'FUNCTION' or (p2 = 'FUNCTION' and p1 in {in_list(S.NAMES)}), false)"
_GENERATOR = f"coalesce((p1 = '*' and p2 = 'FUNCTION') or (p1 in {in_list(S.NAMES)} and p2 = '*' and p3 = 'FUNCTION'), false)"
_CONTROL = f"coalesce(p1 in {in_list(S.CONTROL)} and coalesce(p2, '') <> '.', false)"
_AWAIT = "coalesce(p1 = 'AWAIT' and p2 = 'FOR', false)"


_MARKS = ", ".join(
    f"cast(sum(case {c} else 0 end) over (partition by script_id, level order by pos) as int) as s_{n}" for n, c in {
        "semis": "when kind = ';' then 1", "loops": "when kind = 'IN' or (kind = 'IDENTIFIER' and text = 'of') then 1",
        "gaps": "when kind = ',' and p1 in (',', '(', '{') then 1",
        "does": "when kind = 'DO' and coalesce(p1, '') <> '.' and coalesce(n1, '') not in (':', '(') then 1 when kind = 'WHILE' then -1",
    }.items()
)


def brackets() -> list[str]:
    """Partners by a self join on (level, nth bracket of the level): odd one out against lag and lead."""
    heads = f"""heads as (select *,
        case when kind = '(' then case when {_FUNCTION} then 'function' when {_CONTROL} then 'control' end end as own_head,
        case when kind = '(' then case when {_FUNCTION} or {_GENERATOR} then 'function' when {_CONTROL} or {_AWAIT} then 'control' end end as own_head_std,
        sum(case when kind = ',' then 1 else 0 end) over (partition by script_id, level order by pos) as commas,
        {_MARKS},
        row_number() over (partition by script_id, level, is_open or is_close order by pos) as nth from nb)"""
    pairs = """pairs as (select o.script_id, o.pos as open_pos, c.pos as close_pos, o.kind as open_kind, c.kind as close_kind,
        c.pos = o.pos + 1 as empty_, c.s_semis - o.s_semis as semis, c.s_loops - o.s_loops as loops, c.s_gaps - o.s_gaps as gaps, c.s_does - o.s_does as does,
        case when c.pos = o.pos + 1 then 0 else c.commas - o.commas + 1 - case when c.p1 = ',' then 1 else 0 end end as items,
        c.n1 as after, c.n1t as after_t, o.p1 as open_p1, o.p2 as open_p2, o.p3 as open_p3, o.p4 as open_p4,
        o.p1t as open_p1t, o.p2t as open_p2t, o.p3t as open_p3t, o.p4t as open_p4t, o.newline_before as open_newline,
        o.own_head as head, o.own_head_std as head_std, o.level as pair_level, o.nth as open_nth
        from heads o join heads c on o.script_id = c.script_id and o.level = c.level and c.nth = o.nth + 1
        where o.is_open and c.is_close)"""
    bodies = """bodies as (select b.script_id, b.open_pos, h.open_p1 as body_p1, h.head as body_of, h.head_std as body_of_std
        from pairs b join pairs h on b.script_id = h.script_id and h.close_pos = b.open_pos - 1
        where b.open_kind = '{' and h.close_kind = ')' and b.pair_level = h.pair_level)"""
    br = """br as (select t.*, coalesce(p.open_pos, c.open_pos) is not null as paired,
        case when t.is_open then p.close_pos else c.open_pos end as partner_pos,
        case when t.is_open then p.close_kind else c.open_kind end as partner_kind,
        coalesce(p.items, c.items) as items,
        case when t.is_open then p.after when t.is_close then t.n1 end as after,
        case when t.is_open then p.after_t when t.is_close then t.n1t end as after_t,
        case when t.is_open then t.p1 else c.open_p1 end as open_p1, case when t.is_open then t.p2 else c.open_p2 end as open_p2,
        case when t.is_open then t.p3 else c.open_p3 end as open_p3, case when t.is_open then t.p4 else c.open_p4 end as open_p4,
        case when t.is_open then t.p1t else c.open_p1t end as open_p1t, case when t.is_open then t.p2t else c.open_p2t end as open_p2t,
        case when t.is_open then t.p3t else c.open_p3t end as open_p3t, case when t.is_open then t.p4t else c.open_p4t end as open_p4t,
        case when t.is_open then t.newline_before else c.open_newline end as open_newline,
        case when t.is_open then t.own_head else c.head end as head, case when t.is_open then t.own_head_std else c.head_std end as head_std,
        b.body_of, b.body_of_std, b.body_p1, coalesce(p.empty_, c.empty_, false) as empty_,
        coalesce(p.semis, c.semis, case when t.kind = 'EOF' then t.s_semis end) as semis, coalesce(p.loops, c.loops, case when t.kind = 'EOF' then t.s_loops end) as loops,
        coalesce(p.gaps, c.gaps, case when t.kind = 'EOF' then t.s_gaps end) as gaps, coalesce(p.does, c.does, case when t.kind = 'EOF' then t.s_does end) as does,
        case when t.kind in ('(', ')') then case when case when t.is_open then p.after else t.n1 end = '=>' then 'arrow'
             else coalesce(case when t.is_open then t.own_head else c.head end, 'other') end end as paren_role
        from heads t left join pairs p on t.is_open and t.script_id = p.script_id and t.pos = p.open_pos
        left join pairs c on t.is_close and t.script_id = c.script_id and t.pos = c.close_pos
        left join bodies b on b.script_id = t.script_id and b.open_pos = coalesce(p.open_pos, c.open_pos))"""
    return [heads, pairs, bodies, br]


def enclosing(source: str) -> str:
    facts = "{'pos': pos, 'kind': kind, 'head_std': head_std, 'paren_role': paren_role, 'after': after, 'after_t': after_t, 'p1': p1, 'p2': p2}"
    return f"""enc as (select *, last_value(case when is_open then {facts} end ignore nulls) over
        (partition by script_id, level order by pos rows between unbounded preceding and 1 preceding) as encl from {source})"""


def conditionals() -> list[str]:
    """Conditional colons by a recount per braces: the clamped counter as sum minus running minimum."""
    return [
        """bs as (select *, last_value(case when kind = '{' then {'pos': pos, 'level': level, 'p1': p1} end ignore nulls) over
            (partition by script_id, brace_depth order by pos) as brace from br)""",
        """cs as (select *, sum(case kind when '?' then 1 when ':' then -1 else 0 end) over
            (partition by script_id, brace_depth, brace.pos order by pos) as qsum from bs)""",
        """cm as (select *, coalesce(qsum - least(min(qsum) over (partition by script_id, brace_depth, brace.pos order by pos), 0), 0) as pending from cs)""",
        """cp as (select *, coalesce(lag(pending) over (partition by script_id, brace_depth, brace.pos order by pos), 0) as pending_before from cm)""",
        """cond as (select *, case kind when ':' then pending_before > 0 when '?' then true end as conditional,
            case when kind in (';', 'EOF') then pending_before > 0 end as ternary_open,
            case when kind = '?' then pending when kind = ':' and pending_before > 0 then pending_before end as cond_level from cp)""",
    ]


def braces() -> list[str]:
    """Kinds top-down: a brace after a plain colon takes its kind from the nearest settled braces around."""
    return [
        f"""own as (select *, case when kind in ('{{', '}}') then case when body_of = 'function' then 'function'
            when open_p1 is null or open_p1 in {in_list(S.BLOCK_AFTER)} then 'block'
            when open_p1 = ':' then case when before_open then 'object' end
            when open_newline and open_p1 in {in_list(S.CAN_END + S.RESTRICTED)} then 'block' else 'object' end end as own_kind
            from (select t.*, case when t.kind in ('{{', '}}') and t.open_p1 = ':' then coalesce(c.conditional, false) else false end as before_open
                  from cond t left join (select script_id, pos, conditional from cond where kind = ':') c
                  on c.script_id = t.script_id and c.pos = case when t.is_open then t.pos - 1 else t.partner_pos - 1 end))""",
        """nest as (select *, sum(case when own_kind is not null and kind = '{' then 1 when own_kind is not null and kind = '}' then -1 else 0 end)
            over (partition by script_id order by pos) as nest_level from own)""",
        """brc as (select *, case when kind in ('{', '}') then coalesce(own_kind, case when nest_level > 0 and
            last_value(case when kind = '{' then own_kind end ignore nulls) over (partition by script_id, nest_level order by pos) = 'object'
            then 'object' else 'block' end) end as brace_kind from nest)""",
    ]


def insertions() -> list[str]:
    start = in_list(S.STATEMENT_START_AFTER)
    flags = """fl as (select *, coalesce(kind = ')' and head = 'control', false) as c_control,
        coalesce(kind = ')' and head_std = 'control', false) as c_control_std,
        coalesce((kind = ')' and head = 'function') or (kind = '}' and body_of = 'function'), false) as c_function,
        coalesce((kind = ')' and head_std = 'function') or (kind = '}' and body_of_std = 'function'), false) as c_function_std,
        coalesce(kind = '}' and open_p1 = 'DO', false) as c_do from brc)"""
    prevs = f"""pv as (select *, coalesce(lag(c_control) over w, false) as pc, coalesce(lag(c_control_std) over w, false) as pc_std,
        coalesce(lag(c_function) over w, false) as pf, coalesce(lag(c_function_std) over w, false) as pf_std,
        coalesce(p1 is null or p1 in {start} or coalesce(lag(c_control) over w, false), false) as statement_position,
        coalesce(p2 is null or p2 in {start} or coalesce(lag(c_control, 2) over w, false), false) as async_position,
        kind = 'WHILE' and coalesce(lag(c_do) over w, false) as do_tail
        from fl window w as (partition by script_id order by pos))"""
    forms = """fm as (select *, case when kind = 'FUNCTION' then case when statement_position or (coalesce(p1, '') = 'ASYNC' and async_position)
        then 'declaration' else 'expression' end end as function_form,
        coalesce(p1 = ')' and last_value(case when do_tail then pos end ignore nulls) over w = lag(partner_pos) over w - 1, false) as p_do
        from pv window w as (partition by script_id order by pos))"""

    def rule(standard: bool) -> str:
        control, function = ("pc_std", "pf_std") if standard else ("pc", "pf")
        plain = "(kind = '(' and coalesce(paren_role, '') <> 'arrow')"
        fn_paren = f"({plain} and coalesce(n1 = 'FUNCTION', false))"
        stop = in_list(S.CONTINUES if standard else S.SUPPRESS)
        do_while = "when p_do and kind <> ';' then 'do_while'" if standard else ""
        return f"""case when p1 is null or p1 in (';', '{{') then null {do_while} when {control} then null
            when {function} and coalesce(function_form, '') = 'declaration' then 'after_function'
            when {function} and (kind in ('{{', '[', '.') or {plain}) then null
            when p1 = ')' and kind = '=>' then null
            when p1 in {in_list(S.RESTRICTED)} then case when newline_before or kind in ('EOF', '}}') then 'restricted' end
            when kind in ('CATCH', 'FINALLY') or (p1 = '}}' and kind in ('ELSE', 'WHILE')) then null
            when p1 not in {in_list(S.CAN_END)} then null
            when kind = 'EOF' then 'end_of_file'
            when kind = '}}' then case when coalesce(brace_kind, '') <> 'object' then 'close_brace' end
            when newline_before and {fn_paren} then 'function_paren'
            when newline_before and kind not in {stop} and not {plain} and kind <> ';' then 'newline' end"""

    asi = f"asi as (select *, {rule(False)} as asi_reference, {rule(True)} as asi_standard from fm)"
    return [flags, prevs, forms, asi]


def chain(corpus: str, upto: str, *, placed: bool = False) -> list[str]:
    """Expressions up to a stage: tok, nb, br, cond, brc or asi."""
    ctes = [scripts(corpus), *tokens()]
    if placed:
        ctes.append(POSITIONS_SUM)
    if upto == "tok":
        return ctes
    ctes.append(neighbours("placed" if placed else "tok"))
    stages = [("nb", []), ("br", brackets()), ("cond", conditionals()), ("brc", braces()), ("asi", insertions())]
    for name, parts in stages:
        ctes += parts
        if name == upto:
            return ctes
    raise ValueError(upto)


def statement(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select
