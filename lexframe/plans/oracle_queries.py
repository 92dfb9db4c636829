"""Final selects of the oracle statements, one per registered query."""

from __future__ import annotations

from lexframe.functions import adjacency as A
from lexframe.functions import patterns as P
from lexframe.operators import rules as R
from lexframe.operators import structure as S
from lexframe.operators.logs import CATEGORIES, LAZY_LINE, STRICT_LINE
from lexframe.plans.oracle import chain, enclosing, in_list, q, scripts, statement
from lexframe.sources import corpus as C
from lexframe.sources import snippets as N

NAMES = in_list(S.NAMES)
OPERAND_END = [k for k in S.CAN_END if k not in ("DEFAULT", "++", "--")]
WORDS_OR_ID = in_list(A.WORDS + ["IDENTIFIER"])
_PROPERTY = f"""(coalesce(p1 = '.', false) or coalesce(n1 = ':' and p1 in ('{{', ','), false) or coalesce(n1 = '(' and kind in {in_list([w for w in A.WORDS if w != "FUNCTION"])}
    and not newline_before and (p1 = 'ASYNC' or (p1 = 'IDENTIFIER' and p1t in ('get', 'set', 'static') and kind not in ('IN', 'INSTANCEOF')) or (p1 = '*' and (p2 in ('{{', '}}', ';', ',', 'ASYNC') or coalesce(p2t = 'static', false)))), false))"""


def _kw(*names: str) -> str:
    return f"(kind in {in_list(names)} and not {_PROPERTY})"


def lexical() -> dict[str, str]:
    hexa = "list_reduce([0.0::double] || list_transform(string_split(lower(text[3:]), ''), lambda d: (instr('0123456789abcdef', d) - 1)::double), lambda a, d: a * 16 + d)"
    number = f"case when lower(left(text, 2)) = '0x' then {hexa} else try_cast(text as double) end"
    lits = in_list(["NUMBER", "STRING", "REGEX", "TRUE", "FALSE", "NULL", "UNDEFINED"])
    values = f"""select script_id, pos, case when kind in ('TRUE', 'FALSE') then 'boolean' else lower(kind) end as literal_kind,
        case when kind = 'NUMBER' then {number} end as number_value,
        case when kind = 'STRING' then case when length(text) >= 2 then text[2:length(text) - 1] else text end end as string_value,
        case when kind = 'REGEX' then regexp_extract(text, '\\A/([\\s\\S]*)/[a-z]*\\z', 1) end as regex_pattern,
        case when kind = 'REGEX' then regexp_extract(text, '/([a-z]*)\\z', 1) end as regex_flags,
        case when kind in ('TRUE', 'FALSE') then kind = 'TRUE' end as boolean_value from tok where kind in {lits}"""
    counts = """select script_id, cast(coalesce(min(case when kind = 'ERROR' then pos end) + 1, count(*)) as bigint) as n_tokens,
        case when min(case when kind = 'ERROR' then pos end) is not null then 'ERROR' else 'EOF' end as last_kind from tok group by 1"""
    freq = """select text as name, count(*) as n_uses, count(distinct script_id) as n_scripts from tok where kind = 'IDENTIFIER' group by 1"""
    out = {
        "page_scripts": (scripts("pages"), "select script_id, path, ext, size, src from scripts"),
        "tokenize": ("all", "select script_id, pos, kind, family, text, newline_before from tok"),
        "token_class": ("all", "select kind, family, count(*) as n_tokens, count(distinct text) as n_texts from tok group by 1, 2"),
        "token_positions": ("placed", "select script_id, pos, kind, off, line, col from placed"),
        "module_mode": (
            "code",
            "select script_id, pos, kind as module_kind, case when kind in ('IMPORT', 'EXPORT') then 'IDENTIFIER' else kind end as script_kind from tok where kind in ('IMPORT', 'EXPORT', 'IDENTIFIER')",
        ),
        "literal_values": ("code", values),
        "literals": (
            "code",
            f"select literal_kind, count(*) as n, min(number_value) as min_number, max(number_value) as max_number, max(length(string_value)) as max_string_length from ({values}) group by 1",
        ),
        "lex_errors": (
            "placed",
            "select script_id, pos, line, col, text, case when text = '`' then 'template_unparsed' else 'bad_character' end as rule, "
            "row_number() over (partition by script_id order by pos) = 1 as is_first from placed where kind = 'ERROR'",
        ),
        "token_counts": ("all", counts),
        "write_tokens": (
            "code",
            """select lower(replace(ext, '.', '')) as ext, count(*) as n_tokens, count(distinct script_id) as n_scripts
               from tok join scripts using (script_id) group by 1""",
        ),
        "scan_scripts": (scripts("pages"), "select '.txt' as ext, strlen(src) + 1 as size, src || chr(10) as src from scripts"),
        "identifier_freq": ("all", freq),
        "identifier_cardinality": ("all", "select script_id, count(distinct text) as n_distinct from tok where kind = 'IDENTIFIER' group by 1"),
        "identifier_topk": ("all", freq + " order by n_uses desc, name limit 20"),
        "template_segments": (
            "code",
            """select script_id, pos, kind, cast(level as int) as level,
               case when kind in ('TEMPLATE_HEAD', 'TEMPLATE_MIDDLE') then text[2:length(text) - 2] else text[2:length(text) - 1] end as segment
               from (select *, sum(case kind when 'TEMPLATE_HEAD' then 1 when 'TEMPLATE_TAIL' then -1 else 0 end) over (partition by script_id order by pos)
                     + case when kind in ('TEMPLATE_TAIL', 'TEMPLATE_NO_SUB') then 1 else 0 end as level from tok)
               where starts_with(kind, 'TEMPLATE')""",
        ),
    }
    made = {}
    for key, (corpus, select) in out.items():
        if corpus == "placed":
            from lexframe.plans.oracle import POSITIONS_SUM

            made[key] = statement([*chain("all", "tok"), POSITIONS_SUM], select)
        elif corpus.startswith("scripts as"):
            made[key] = statement([corpus], select)
        else:
            made[key] = statement(chain(corpus, "tok"), select)
    return made


def structural() -> dict[str, str]:
    pairs = """select a.script_id, a.pos as question_pos, min(b.pos) as colon_pos from cond a left join cond b
        on a.script_id = b.script_id and a.brace_depth = b.brace_depth and a.brace.pos is not distinct from b.brace.pos
        and a.cond_level = b.cond_level and b.kind = ':' and b.conditional and b.pos > a.pos
        where a.kind = '?' group by 1, 2"""
    out = {
        "bracket_depth": ("nb", "select script_id, pos, kind, paren_depth, brace_depth, bracket_depth from nb"),
        "bracket_match": ("br", "select script_id, pos, kind, partner_pos, partner_kind from br where is_open or is_close"),
        "paren_role": ("br", "select script_id, pos, partner_pos as close_pos, paren_role from br where kind = '('"),
        "ternary_match": ("cond", pairs),
        "brace_kind": ("brc", "select script_id, pos, brace_kind from brc where kind = '{'"),
        "function_position": ("asi", "select script_id, pos, function_form from asi where kind = 'FUNCTION'"),
        "asi_points": (
            "asi",
            "select script_id, pos, p1, kind, asi_reference, asi_standard from asi where asi_reference is not null or asi_standard is not null",
        ),
    }
    return {k: statement(chain("code", stage), select) for k, (stage, select) in out.items()}


# --- methods, clauses, rules -------------------------------------------------------------------------------


_MEMBERS = f"coalesce(after = '{{' and level = brace.level + 1 and brace.p1 not in {in_list(S.BLOCK_AFTER)}, false)"


def method_ctes(source: str) -> list[str]:
    keys = in_list(S.NAMES + ["STRING", "NUMBER", "]"] + [w for w in A.WORDS if w != "FUNCTION"])
    before = ", ".join(
        f"case when p1 = ']' then lag(open_p{i}{x}) over w else p{i + 1}{x} end as b{i}{x}" for i in range(1, 5) for x in ("", "t")
    )
    class_ends = in_list([k for k in S.CAN_END if k != "DEFAULT"] + ["CLASS"])
    return [
        f"mb as (select *, {before} from {source} window w as (partition by script_id order by pos))",
        "ms as (select *, coalesce(b1 = '*', false) as star from mb)",
        """mc as (select *, case when star then b2 else b1 end as c1, case when star then b2t else b1t end as c1t,
            case when star then b3 else b2 end as c2, case when star then b3t else b2t end as c2t,
            case when star then b4t else b3t end as c3t from ms)""",
        "ma as (select *, coalesce(c1 = 'ASYNC', false) as is_async from mc)",
        """mw as (select *, coalesce(case when is_async then c2 else c1 end = 'IDENTIFIER', false) as named1,
            case when is_async then c2t else c1t end as word1,
            not is_async and coalesce(c2 = 'IDENTIFIER', false) as named2,
            case when is_async then c3t else c2t end as word2 from ma)""",
        f"""mth as (select *, coalesce(kind = '(' and after = '{{' and ((head is null and head_std is null) or (p1 in {in_list(S.CONTROL)} and {_MEMBERS})) and p1 in {keys}
            and level = brace.level + 1 and coalesce(b1, '') not in ('.', 'NEW'), false) as is_method,
            coalesce(brace.p1 in {class_ends}, false) as in_class,
            p1 = ']' as computed, case when p1 = ']' then null else p1t end as mname,
            coalesce((named1 and word1 = 'static') or (named1 and named2 and word2 = 'static'), false) as is_static,
            coalesce(case when not named1 then true when named2 then word2 = 'static' and word1 in ('get', 'set')
                 else word1 in ('static', 'get', 'set') end, false) as prefix_ok,
            case when named1 and word1 in ('get', 'set') then word1 end as accessor from mw)""",
    ]


_METHOD_KIND = "coalesce(accessor, case when in_class and not is_static and mname = 'constructor' then 'constructor' else 'method' end)"


def clause_cte(source: str) -> str:
    return f"""cl as (select *, case when mark >= 0 then mark end as clause_pos from (select *, last_value(
        case when kind in ('IMPORT', 'EXPORT') and coalesce(p1, '') <> '.' and n1 in {in_list(S.NAMES + ['{', '*'])} then pos
             when kind in ('STRING', ';', 'IMPORT', 'EXPORT', 'VAR', 'LET', 'CONST', 'FUNCTION', 'CLASS', '=') then -1 end ignore nulls)
        over (partition by script_id order by pos rows between unbounded preceding and 1 preceding) as mark from {source}))"""


def rule_conditions() -> dict[str, str]:
    mates = "map {'(': ')', '[': ']', '{': '}', ')': '(', ']': '[', '}': '{', 'TEMPLATE_HEAD': 'TEMPLATE_TAIL', 'TEMPLATE_TAIL': 'TEMPLATE_HEAD'}"
    params = "(encl.kind = '(' and (coalesce(encl.head_std = 'function', false) or encl.paren_role = 'arrow' or coalesce(encl.after = '{', false)))"
    pattern = f"(encl.kind in ('[', '{{') and encl.p1 in {in_list(A.DECLARE)})"
    in_for = "(encl.p1 = 'FOR' or (encl.p1 = 'AWAIT' and encl.p2 = 'FOR'))"
    return {
        "template_unparsed": "kind = 'ERROR' and text = '`'",
        "bad_character": "kind = 'ERROR' and text <> '`'",
        "bracket_unmatched": "(is_open or is_close) and partner_pos is null",
        "bracket_crossing": f"is_close and partner_kind <> {mates}[kind]",
        "newline_arrow": "kind = '=>' and newline_before",
        "newline_yield": f"p1 = 'YIELD' and newline_before and kind not in {in_list(S.YIELD_NEWLINE_OK + ['EOF'])}",
        "getter_arity": f"is_method and {_METHOD_KIND} = 'get' and items <> 0",
        "setter_arity": f"is_method and {_METHOD_KIND} = 'set' and items <> 1",
        "static_constructor": "is_method and in_class and is_static and mname = 'constructor'",
        "class_prefix": "is_method and in_class and not prefix_ok",
        "expected_from": f"clause_pos is not null and kind in {NAMES} and n1 = 'STRING' and p1 in {in_list(S.NAMES + ['}', '*'])} and text <> 'from'",
        "expected_as": f"clause_pos is not null and kind in {NAMES} and p1 in {in_list(S.NAMES + ['DEFAULT', '*'])} and n1 in {in_list(S.NAMES + ['DEFAULT'])} and text <> 'as' and p1t <> 'as'",
        "expected_of": f"{in_for} and kind in {NAMES} and p1 in {in_list(S.NAMES + [']', '}'])} and text <> 'of' and p1t <> 'of'",
        "rest_last": f"kind = '...' and ({params} or {pattern}) and rest_end in (',', '=') and not coalesce(encl.kind = '[' and rest_end = ',' and n1 in {NAMES} and n3 = ']', false)",
    }


def clause_conditions() -> dict[str, str]:
    header = "(kind = '(' and head_std = 'control')"
    loop = "coalesce(p1 in ('FOR', 'AWAIT'), false)"
    default = "(coalesce(p1 in ('DEFAULT', 'CASE'), false) or coalesce(p1 = 'ASYNC' and p2 in ('DEFAULT', 'CASE'), false))"
    stands = f"(inner_.pos is null or inner_.p1 is null or inner_.p1 in {in_list(S.BLOCK_AFTER)})"
    return {
        "empty_header": f"{header} and not {_MEMBERS} and not {loop} and (empty_ or semis > 0)",
        "for_header": f"{header} and not {_MEMBERS} and {loop} and not (semis = 2 or (semis = 0 and loops > 0))",
        "list_comma": "kind in (')', '}', 'EOF') and gaps > 0",
        "switch_body": "kind = '{' and body_p1 = 'SWITCH' and not empty_ and n1 not in ('CASE', 'DEFAULT')",
        "try_alone": "kind = '}' and open_p1 = 'TRY' and n1 not in ('CATCH', 'FINALLY')",
        "do_alone": "kind in (')', ']', '}', 'EOF') and does > 0",
        "ternary_open": "ternary_open",
        "unnamed": f"(kind = 'FUNCTION' and function_form = 'declaration' and (n1 = '(' or (n1 = '*' and n2 = '(')) and {stands} and not {default}) "
        f"or (kind = 'CLASS' and statement_position and n1 in ('{{', 'EXTENDS') and not {default})",
    }


def inner_cte(source: str) -> str:
    return f"""inn as (select *, case when n1 = '*' then lead(brace, 2) over w else lead(brace) over w end as inner_
        from {source} window w as (partition by script_id order by pos))"""


REST_END = """re as (select *, case when n1 in ('[', '{') then lead(after) over (partition by script_id order by pos) else n2 end as rest_end from cl)"""


def pair_ctes(source: str) -> list[str]:
    class_body = in_list([k for k in S.CAN_END if k != "DEFAULT"] + ["CLASS"])
    right = f"""case when p1 = '.' and kind in {WORDS_OR_ID} then 'PROPERTY'
        when kind in {in_list(A.WORDS)} and n1 = ':' and p1 in ('{{', ',') then 'NAME'
        when kind in {in_list(A.WORDS)} and n1 = '(' and p1t in {in_list(A.METHOD_LEAD)} and kind not in ('FUNCTION', 'AWAIT', 'YIELD') then 'NAME'
        when kind = 'IDENTIFIER' and text in {in_list(A.CONTEXTUAL)} then upper(text)
        when kind in {NAMES} then 'NAME' when kind in ('NUMBER', 'REGEX', 'TRUE', 'FALSE', 'NULL') then 'LITERAL'
        when kind in ('THIS', 'SUPER') then 'SELF' when kind in ('TEMPLATE_NO_SUB', 'TEMPLATE_HEAD') then 'TEMPLATE'
        when kind in ('TEMPLATE_MIDDLE', 'TEMPLATE_TAIL') then 'TEMPLATE_END' when kind in {in_list(A.DECLARE)} then 'DECLARE'
        when kind in {in_list(A.PREFIX)} then 'PREFIX' when kind in ('+', '-') then 'SIGN' when kind in ('++', '--') then 'UPDATE'
        when kind in {in_list(A.ASSIGN)} then 'ASSIGN' when kind in {in_list(A.INFIX)} then 'INFIX' else kind end"""
    left = f"""case when kind = ')' then case when paren_role = 'arrow' then 'ARROW_HEAD' when head_std = 'control' then 'CONTROL_HEAD'
            when head_std = 'function' then 'FUNCTION_HEAD' else 'CALL' end
        when kind = '}}' then case when brace_kind = 'object' and not coalesce(open_p1 in {class_body}, false) then 'OBJECT' else 'BLOCK' end
        when kind in ('++', '--') then case when p1 in {in_list(OPERAND_END)} and not newline_before then 'POSTFIX' else 'UPDATE' end
        when right_class = 'NAME' and p1 in ('CLASS', 'EXTENDS') then 'CLASS_NAME'
        when kind in ('TEMPLATE_NO_SUB', 'TEMPLATE_TAIL') then 'TEMPLATE_END' when kind = 'TEMPLATE_MIDDLE' then 'TEMPLATE' else right_class end"""
    legal = ", ".join(f"({q(a)}, {q(b)})" for a, b in A.legal_pairs())
    return [
        f"rc as (select *, {right} as right_class from {source})",
        f"lc as (select *, {left} as own_left from rc)",
        "pr as (select *, case when asi_standard is not null then ';' else coalesce(lag(own_left) over (partition by script_id order by pos), 'BOS') end as left_class from lc)",
        f"legal(lc_, rc_) as (values {legal})",
        "adj as (select *, kind <> 'ERROR' and coalesce(p1, '') <> 'ERROR' and not exists (select 1 from legal where lc_ = left_class and rc_ = right_class) as illegal from pr)",
    ]


def diagnostic_ctes(corpus: str) -> list[str]:
    conditions = {**rule_conditions(), **clause_conditions(), "adjacency": "illegal"}
    message = " ".join(f"when {q(k)} then {q(v)}" for k, v in R.MESSAGES.items())
    cases = ", ".join(f"case when {c} then {q(r)} end" for r, c in conditions.items())
    return [
        *chain(corpus, "asi", placed=True), enclosing("asi"), *method_ctes("enc"), clause_cte("mth"), REST_END, inner_cte("re"), *pair_ctes("inn"),
        f"""diag as (select script_id, pos, line, col, rule, case rule {message} end as message from
            (select script_id, pos, line, col, unnest(list_filter([{cases}], lambda r: r is not null)) as rule from adj))""",
    ]


_EXT_OK = f"lower(regexp_extract(path, '\\.[^.]*$')) in {in_list(R.JS_EXTENSIONS)}"
_VERDICT = f"""verdict as (select s.script_id, s.path, case when d.n is null then 'PASS' else 'FAIL' end as verdict, coalesce(d.n, 0) as error_count,
    {_EXT_OK} as ext_ok, case when not ({_EXT_OK}) then case when d.n is null then 'WARN' else 'HINT' end end as ext_note,
    d.first_at.line as first_line, d.first_at.col as first_col
    from scripts s left join (select script_id, count(*) as n, min({{'line': line, 'col': col}}) as first_at from diag group by 1) d using (script_id))"""
_OUTCOME = f"""outcome as (select script_id, path, case when regexp_matches(path, '{R.EXPECT_ERROR}') then
    case when verdict = 'FAIL' then 'PASS (caught)' else 'FAIL (unexpected success)' end else verdict end as outcome from verdict)"""


def checks() -> dict[str, str]:
    rules_base = [*chain("all", "cond"), enclosing("cond"), *method_ctes("enc"), clause_cte("mth"), REST_END]
    conditions = rule_conditions()
    groups = {
        "rule_bracket": ["bracket_unmatched", "bracket_crossing"],
        "rule_newline_arrow": ["newline_arrow"],
        "rule_newline_yield": ["newline_yield"],
        "rule_accessor_arity": ["getter_arity", "setter_arity"],
        "rule_static_constructor": ["static_constructor"],
        "rule_class_prefix": ["class_prefix"],
        "rule_contextual": ["expected_from", "expected_as", "expected_of"],
        "rule_rest_last": ["rest_last"],
    }
    out = {
        key: statement(
            rules_base,
            " union all ".join(f"select script_id, pos, {q(r)} as rule from re where {conditions[r]}" for r in names),
        )
        for key, names in groups.items()
    }
    out["adjacency_errors"] = statement(
        [*chain("all", "asi"), *pair_ctes("asi")], "select script_id, pos, left_class, right_class from adj where illegal"
    )
    out["rule_clause"] = statement(
        [*chain("all", "asi"), inner_cte("asi")],
        " union all ".join(f"select script_id, pos, {q(r)} as rule from inn where {c}" for r, c in clause_conditions().items()),
    )
    diag = diagnostic_ctes("all")
    out["all_diagnostics"] = statement(diag, "select script_id, pos, line, col, rule, message from diag")
    out["script_verdict"] = statement([*diag, _VERDICT], "select * from verdict")
    out["test_report"] = statement(
        [*diag, _VERDICT, _OUTCOME],
        """select coalesce(dir, '(all)') as dir, count(*) as total, count(*) filter (outcome = 'PASS') as passed,
           count(*) filter (outcome = 'PASS (caught)') as caught, count(*) filter (outcome = 'FAIL') as failed,
           count(*) filter (outcome = 'FAIL (unexpected success)') as unexpected
           from (select *, regexp_replace(path, '/[^/]*$', '') as dir from outcome) group by rollup(dir)""",
    )
    pages_diag = diagnostic_ctes("pages")
    out["stream_verdict"] = statement([*pages_diag, _VERDICT], "select * from verdict")
    out["write_error_log"] = statement(
        diagnostic_ctes("code"), "select path, line, col, message, false as _bad from diag join scripts using (script_id)"
    )
    out["ext_gate"] = statement([scripts("all")], f"select script_id, path, {_EXT_OK} as ext_ok from scripts")
    out["expected_outcome"] = statement(
        [scripts("all")], f"select script_id, path, regexp_matches(path, '{R.EXPECT_ERROR}') as error_expected from scripts"
    )
    out["run_delta"] = statement(
        [*diagnostic_ctes("code"), _VERDICT,
         "before as (select script_id, case when script_id in (select script_id from diag where rule <> 'adjacency') then 'FAIL' else 'PASS' end as verdict from scripts)",
         "after as (select script_id, case when script_id in (select script_id from diag where rule not in ('bad_character', 'newline_arrow')) then 'FAIL' else 'PASS' end as verdict from scripts)"],
        """select a.script_id, case when a.verdict = 'FAIL' and b.verdict = 'FAIL' then 'still failing'
           when a.verdict = 'FAIL' then 'newly failing' else 'newly passing' end as change
           from after a join before b using (script_id) where a.verdict = 'FAIL' or b.verdict = 'FAIL'""",
    )
    return out


# --- nodes -------------------------------------------------------------------------------------------------

_SOURCE = """src_ as (select *, nullif(last_value(case when kind = 'STRING' and (coalesce(p1t = 'from', false) or coalesce(p1 = 'IMPORT', false)) then text[2:length(text) - 1]
        when kind in (';', 'IMPORT', 'EXPORT') then '' end ignore nulls) over
        (partition by script_id order by pos desc rows between unbounded preceding and 1 preceding), '') as source,
    last_value(case when kind in ('IMPORT', 'EXPORT') then kind end ignore nulls) over
        (partition by script_id order by pos rows between unbounded preceding and 1 preceding) as clause_kind from <SRC>)"""

_DECLARATORS = [
    f"""dm as (select *, last_value(case when {_kw(*A.DECLARE)} then {{'k': lower(kind), 'x': coalesce(p1 = 'EXPORT', false)}}
        when kind in (';', 'IN') or (kind = 'IDENTIFIER' and text = 'of') or is_open or asi_standard is not null then {{'k': null, 'x': false}} end ignore nulls)
        over (partition by script_id, level order by pos) as mark_ from enc)""",
    f"ds as (select *, case when {_kw(*A.DECLARE)} or (kind = ',' and mark_.k is not null) then mark_ end as split_ from dm)",
    f"""dc as (select *, prev_.k as decl_kind, coalesce(prev_.x, false) as decl_export,
        prev_.k is not null and kind in {in_list(S.NAMES + ['{', '['])} as declares
        from (select *, lag(split_) over (partition by script_id order by pos) as prev_ from ds))""",
]

_IS_CALL = f"""(kind = '(' and (p1 in {in_list(S.NAMES + ['THIS', 'SUPER', ')', ']', '}', 'TEMPLATE_NO_SUB', 'TEMPLATE_TAIL'])} or coalesce(p2 = '.', false))
    and head_std is null and coalesce(after, '') <> '{{' and paren_role <> 'arrow')"""
_CALLEE = f"case when p1 in {in_list(S.NAMES + ['THIS', 'SUPER'])} or coalesce(p2 = '.', false) then p1t end"
_SELF = in_list(S.NAMES + ["THIS", "SUPER"])
_CHAIN = f"""chn as (select *, case when part then last_value(case when part and not (coalesce(p1 = '.', false) or (kind = '.' and (coalesce(p1 in {_SELF}, false) or coalesce(p2 = '.', false))))
        then {{'pos': pos, 'p1': p1}} end ignore nulls) over (partition by script_id order by pos) end as chain_
    from (select *, kind in {_SELF} or kind = '.' or coalesce(p1 = '.', false) as part from <SRC>))"""
_OPERAND = f"(coalesce(p1 in {in_list(OPERAND_END)}, false) or coalesce(p2 = '.', false))"
_BINARY = [o for o in A.INFIX if o not in ("&&", "||")] + ["+", "-", "*", "IN"]
_OPERATOR = f"""case when kind in ('++', '--') then case when {_OPERAND} and not newline_before then 'update_postfix' else 'update_prefix' end
    when {_kw('TYPEOF', 'DELETE', 'VOID', '!', '~')} then 'unary'
    when kind = 'AWAIT' then case when coalesce(p1, '') <> 'FOR' then 'unary' end
    when kind in ('+', '-') then case when {_OPERAND} then 'binary' else 'unary' end
    when kind = '*' then case when {_OPERAND} and coalesce(p1, '') not in (';', '{{', '}}') then 'binary' end
    when kind in ('&&', '||') then 'logical' when kind in {in_list(['='] + A.ASSIGN)} then 'assignment' when kind = '?' then 'ternary'
    when {_kw(*_BINARY)} then 'binary' end"""


def _operand_ctes() -> list[str]:
    """Operands by joins of every operator with the tokens of its level that may end one."""
    strengths = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">=", "IN", "INSTANCEOF"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]
    strength = " ".join(f"when kind in {in_list(group)} then {i}" for i, group in enumerate(strengths, 4))
    words = ["RETURN", "THROW", "VAR", "LET", "CONST", "CASE", "DEFAULT", "ELSE", "DO", "EXPORT", "IMPORT", "YIELD"]
    called = f"(coalesce(ar.p1 in {in_list(OPERAND_END + ['ASYNC'])}, false) or coalesce(ar.p2 = '.', false))"
    comma = f"""(kind = ',' and not (mark_.k is not null) and not coalesce(p2 = 'IMPORT', false) and case when ar.kind is null then true
        when ar.kind = '(' then (coalesce(ar.head_std = 'control', false) and not coalesce(ar.p2 in ('.', 'ASYNC', '*'), false)) or (ar.head_std is null and ar.paren_role <> 'arrow' and not {called})
        when ar.kind = '[' then coalesce(ar.p1 in {in_list(OPERAND_END)}, false) when ar.kind = '{{' then ar.brace_kind <> 'object' else true end)"""
    return [
        """oa as (select *, last_value(case when is_open then {'pos': pos, 'kind': kind, 'head_std': head_std, 'paren_role': paren_role, 'brace_kind': brace_kind, 'p1': p1, 'p2': p2} end ignore nulls)
             over (partition by script_id, level order by pos rows between unbounded preceding and 1 preceding) as ar, kind = ':' and coalesce(conditional, false) as colon,
             depth + case when is_open then -1 when is_close then 1 else 0 end as on_, kind = '*' and coalesce(n1 = '*', false) as power from dc)""",
        f"""ob as (select *, case when kind = '*' and coalesce(p1 = '*', false) then null when {comma} then 'sequence' else {_OPERATOR} end as cls,
             sum(case when kind = '?' then 1 when colon then -1 else 0 end) over (partition by script_id, on_ order by pos) as bal from oa)""",
        f"""oc as (select *, case cls when 'sequence' then 0 when 'assignment' then 2 when 'unary' then 14 when 'update_prefix' then 14 when 'update_postfix' then 16
               else case when cls = 'ternary' or colon then 3 when cls is null then null when power then 15 {strength} end end as strength,
             coalesce(cls in ('sequence', 'assignment', 'ternary', 'binary', 'logical'), false) or colon as infix, coalesce(cls in ('unary', 'update_prefix'), false) as prefix,
             (kind in (',', ':', ';', 'TEMPLATE_MIDDLE') and cls is null and not colon) or is_close as firm,
             coalesce(last_value(case when {_kw('FUNCTION')} then coalesce(function_form = 'declaration', false) or asi_standard is not null
               when {_kw('CLASS')} then coalesce(statement_position, false) or asi_standard is not null end ignore nulls)
               over (partition by script_id, on_ order by pos rows between unbounded preceding and 1 preceding), false) as declared
             from ob)""",
        f"""od as materialized (select script_id, pos, on_, kind, cls, colon, power, strength, bal, firm, prefix, ar.pos as inside_of, asi_standard is not null as inserted,
             case when (kind = '(' and coalesce(head_std = 'control', false)) or (kind = '{{' and not coalesce(p1 = '=>', false)
               and (brace_kind = 'block' or (declared and (brace_kind = 'function' or (brace_kind = 'object' and coalesce(p1 in {in_list(OPERAND_END + ['CLASS'])}, false)))))) then partner_pos + 1
               when firm or infix or prefix or kind = '=>' or {_kw(*words)} or (kind = 'IDENTIFIER' and text = 'of' and coalesce(p1 in {in_list(S.NAMES + [']', '}'])}, false)) then pos + 1 end as start_,
             case when infix or prefix then strength when kind = '=>' then 1 else -1 end as looser,
             case when firm or asi_standard is not null or kind = 'EOF' then -1 when infix then strength end as ends from oc)""",
        """op as materialized (select script_id, pos, on_, cls, inside_of, case when power then '**' else lower(kind) end as operator, bal - case when kind = '?' then 1 else 0 end as bal,
             case when prefix then null when cls = 'ternary' then 4 when cls = 'assignment' then 17 when power or cls = 'update_postfix' then 16 else strength end as kept_left,
             case when cls = 'update_postfix' then null when cls in ('ternary', 'assignment') then 2 when power then 15 else strength + 1 end as kept_right
           from od where cls is not null)""",
        """op_left as (select o.script_id, o.pos, o.operator, o.cls, cast(case when o.kept_left is not null then
               greatest(coalesce(max(case when t.start_ is not null and t.looser < o.kept_left then t.start_ when t.inserted then t.pos end), 0), coalesce(o.inside_of + 1, 0)) end as int) as left_start
           from op o left join (select * from od where start_ is not null or inserted) t on t.script_id = o.script_id and t.on_ = o.on_ and t.pos < o.pos
           group by o.script_id, o.pos, o.operator, o.cls, o.kept_left, o.inside_of)""",
        """op_right as (select o.script_id, o.pos, cast(case when o.kept_right is not null then
               min(case when t.ends < o.kept_right or (t.colon and t.bal + 1 = o.bal) then t.pos end) - 1 end as int) as right_end
           from op o left join (select * from od where ends is not null) t on t.script_id = o.script_id and t.on_ = o.on_ and t.pos > o.pos group by o.script_id, o.pos, o.kept_right)""",
    ]


_DOTTED = f"(kind = '.' and coalesce(n1 in {WORDS_OR_ID}, false))"
_COMPUTED = f"(kind = '[' and {_OPERAND} and not coalesce(p1 = '}}' and newline_before, false))"

_SIMPLE = ["WHILE", "DO", "SWITCH", "CASE", "TRY", "CATCH", "FINALLY", "WITH", "BREAK", "CONTINUE", "THROW", "RETURN", "IF", "ELSE"]
_CONTROL = [
    """cf1 as (select *, last_value(case when kind = ';' then 'for' when kind = 'IN' then 'for-in' when kind = 'IDENTIFIER' and text = 'of' then 'for-of'
        when is_close then 'none' end ignore nulls) over (partition by script_id, level order by pos desc rows between unbounded preceding and 1 preceding) as first_,
        last_value(case when kind = '{' then brace_kind end ignore nulls) over (partition by script_id, brace_depth order by pos) as kind_in from <SRC>)""",
    """cf2 as (select *, lead(case when kind = '(' then nullif(first_, 'none') end) over w as header_kind, coalesce(lead(conditional) over w, false) as next_cond
        from cf1 window w as (partition by script_id order by pos))""",
    f"""cf as (select *, case when {_kw('FOR')} then case when n1 = 'AWAIT' then 'for-await' else coalesce(header_kind, 'for') end
        when {_kw(*_SIMPLE)} then lower(kind)
        when kind = 'DEFAULT' and n1 = ':' and coalesce(p1, '') not in (',', '.') and coalesce(kind_in, '') <> 'object' then 'default'
        when kind in {NAMES} and n1 = ':' and (p1 is null or p1 in (';', '}}', ')', '{{', 'ELSE', 'DO', ':') or asi_standard is not null)
             and coalesce(kind_in, '') <> 'object' and not next_cond then 'label' end as construct from cf2)""",
]


#: Patterns from the top down: brackets that are patterns by what is around them, then those inside them, level by level.
_PATTERN_TREE = [
    """pt_count as (select *, sum(case when kind = ',' then 1 else 0 end) over (partition by script_id, level order by pos) as commas_ from dc)""",
    """pt_own as (select *, last_value(case when is_open then {'pos': pos, 'kind': kind, 'head': head_std, 'role': paren_role, 'after': after, 'p1': p1, 'p2': p2, 'commas': commas_} end ignore nulls) over w as own_,
         last_value(case when kind in (',', '=') or is_open then kind end ignore nulls) over w as mark2_
       from pt_count window w as (partition by script_id, level order by pos))""",
    """pt_in as (select *, case when is_open then lag(own_) over w else own_ end as parent, case when is_open then lag(mark2_) over w else mark2_ end as seen,
         case when is_open then lag(commas_) over w else commas_ end as commas_here
       from pt_own window w as (partition by script_id order by pos))""",
    f"""pt_facts as (select *, coalesce((parent.kind = '[' and p1 in ('[', ',', '...')) or (parent.kind = '{{' and ((p1 = ':' and seen <> '=') or p1 = '...')), false) as placed_,
         coalesce(parent.kind = '(' and (coalesce(parent.head = 'function', false) or coalesce(parent.role = 'arrow', false) or (parent.after = '{{' and parent.head is null)), false) as param,
         coalesce(kind in {in_list(S.NAMES)} and parent.kind = '{{' and p1 in ('{{', ',') and n1 in (',', '}}', '='), false) as shorthand_
       from pt_in)""",
    f"""pt_roots as (select *, case when kind in ('[', '{{') then case when coalesce(declares, false) then 'declaration'
         when p1 = '(' and coalesce(parent.kind = '(' and parent.p1 = 'CATCH' and coalesce(parent.p2, '') <> '.', false) then 'catch'
         when param and p1 in ('(', ',', '...') then case when parent.role = 'arrow' then 'arrow_parameter' else 'parameter' end
         when coalesce(parent.kind = '(' and parent.p1 in ('FOR', 'AWAIT') and p1 = '(' and (after = 'IN' or (after = 'IDENTIFIER' and after_t = 'of')), false) then 'loop'
         when after = '=' and not placed_ and (coalesce(p1 not in {in_list(S.CAN_END)}, true) or asi_standard is not null or coalesce(statement_position, false)) then 'assignment' end end as root_,
         case when p1 = '...' then '...' when parent.kind = '[' then '[' || cast(commas_here - parent.commas as int) || ']'
              when p1 = ':' then case when p2 = ']' then '[*]' else '.' || p2t end
              when kind in {in_list(S.NAMES)} then '.' || text else '' end as step_
       from pt_facts)""",
    """pt_tree as (with recursive t(script_id, pos, root_pos, position, path, nesting) as (
         select script_id, pos, pos, root_, '', 0 from pt_roots where root_ is not null
         union all select c.script_id, c.pos, t.root_pos, t.position, t.path || c.step_, t.nesting + 1 from t
           join pt_roots c on c.script_id = t.script_id and c.parent.pos = t.pos where c.kind in ('[', '{') and c.placed_ and c.root_ is null)
       select * from t)""",
    """pt_all as (select r.script_id, r.pos, r.kind, r.items, r.after, t.position, t.nesting, t.path from pt_roots r join pt_tree t using (script_id, pos)
       union all select script_id, pos, kind, items, after, 'assignment', 0, '' from pt_roots r
         where kind in ('[', '{') and placed_ and root_ is null and after = '=' and not exists (select 1 from pt_tree t where t.script_id = r.script_id and t.pos = r.pos))""",
    f"""pt_items as (select r.script_id, r.pos, r.text, r.p1, t.pos as parent_pos, t.root_pos, t.position, t.path, r.step_ as step,
         case when kind = ',' then 'hole' when kind in ('[', '{{') then 'bracket' when n1 in ('.', '[', '(') then 'member' else 'name' end as what,
         case when kind in ('[', '{{') then coalesce(after = '=', false) else coalesce(n1 = '=', false) end as has_default,
         shorthand_ as shorthand, coalesce(p1 = ':' and p2 = ']', false) as computed
       from pt_roots r join pt_tree t on t.script_id = r.script_id and t.pos = r.parent.pos
       where (kind in {in_list([*S.NAMES, 'THIS'])} and (placed_ or shorthand_)) or (kind = ',' and r.parent.kind = '[' and p1 in ('[', ','))
         or (kind in ('[', '{{') and placed_ and root_ is null))""",
]


def _import_select() -> str:
    return f"""select script_id, pos, row_.l as local, row_.i as imported, row_.n as is_namespace, row_.d as is_default, source from (
      select *, case
        when {_kw('IMPORT')} and (n1 = 'STRING' or (n1 = '{{' and n2 = '}}')) then {{'l': null::varchar, 'i': null::varchar, 'n': false, 'd': false}}
        when kind in {NAMES} and p1 = 'IMPORT' then {{'l': text, 'i': 'default', 'n': false, 'd': true}}
        when inside and kind in {NAMES} and p1t = 'as' and p2 = '*' then {{'l': text, 'i': null, 'n': true, 'd': false}}
        when inside and kind in {in_list(S.NAMES + ['DEFAULT'])} and encl.kind = '{{' and p1 in ('{{', ',')
          then {{'l': case when n1t = 'as' then n2t else text end, 'i': text, 'n': false, 'd': false}} end as row_
      from (select *, clause_pos is not null and clause_kind = 'IMPORT' as inside from src_)) where row_ is not null"""


def _export_select() -> str:
    def after(i: int) -> str:
        def name(j: int) -> str:
            return f"case when n{j} in {NAMES} then n{j}t end"

        return f"case when n{i} = '*' then {name(i + 1)} else {name(i)} end" if i < 5 else name(i)

    def declared(at: int) -> str:
        return f"case when n{at} = 'ASYNC' then {after(at + 2)} when n{at} in ('FUNCTION', 'CLASS') then {after(at + 1)} end"

    form = "case n{0} when 'FUNCTION' then 'function' when 'ASYNC' then 'function' when 'CLASS' then 'class' end"
    alias = "case when n1t = 'as' then n2t end"
    star_alias = "case when n2t = 'as' then n3t end"
    spec = f"kind in {in_list(S.NAMES + ['DEFAULT'])} and encl.kind = '{{' and encl.p1 = 'EXPORT' and p1 in ('{{', ',')"
    star = f"{_kw('EXPORT')} and n1 = '*'"
    name = f"case when kind in {NAMES} then text end"

    def row(local, exported, default, every, alias_, decl) -> str:
        return f"{{'l': {local}, 'e': {exported}, 'd': {default}, 'a': {every}, 's': {alias_}, 'k': {decl}}}"

    no = "null::varchar"
    return f"""select script_id, pos, row_.l as local, row_.e as exported, row_.d as is_default, row_.a as is_all, row_.s as alias, row_.k as declaration,
      case when {spec} then case when encl.after_t = 'from' then source end when {star} then source end as source from (
      select *, case when {spec} then {row('text', f"coalesce({alias}, text)", 'false', 'false', alias, no)}
        when {star} then {row(no, star_alias, 'false', 'true', star_alias, no)}
        when {_kw('EXPORT')} and n1 = 'DEFAULT' then {row(declared(2), "'default'", 'true', 'false', no, f"coalesce({form.format(2)}, 'expression')")}
        when {_kw('EXPORT')} and n1 in ('FUNCTION', 'CLASS', 'ASYNC') then {row(declared(1), declared(1), 'false', 'false', no, form.format(1))}
        when declares and decl_export then {row(name, name, 'false', 'false', no, 'decl_kind')} end as row_ from src_) where row_ is not null"""


def _imports_ctes(corpus: str) -> list[str]:
    return [*chain(corpus, "br"), enclosing("br"), clause_cte("enc"), _SOURCE.replace("<SRC>", "cl")]


def _exports_ctes(corpus: str) -> list[str]:
    return [*chain(corpus, "asi"), enclosing("asi"), *_DECLARATORS, _SOURCE.replace("<SRC>", "dc")]


def _methods_select() -> str:
    return f"""select script_id, pos, case when in_class then 'class' else 'object' end as owner, mname as name, computed, is_static,
        star as generator, is_async, {_METHOD_KIND} as method_kind, items as param_count from mth where is_method"""


def _classes() -> str:
    ctes = [*chain("code", "asi"), enclosing("asi"), *method_ctes("enc")]
    bodies = f"""heads_ as (select script_id, pos, depth, brace_depth, case when statement_position or coalesce(p1 in ('EXPORT', 'DEFAULT'), false) or asi_standard is not null
            then 'declaration' else 'expression' end as form, case when n1 in {NAMES} then n1t end as name,
            coalesce(case when n1 in {NAMES} then n2 else n1 end = 'EXTENDS', false) as has_superclass from mth where {_kw('CLASS')})"""
    open_ = f"""opens_ as (select script_id, pos, depth - 1 as outer_ from mth where kind = '{{' and open_p1 in {in_list(OPERAND_END + ['CLASS'])})"""
    matched = """body_ as (select h.script_id, h.pos, min(o.pos) as body_pos from heads_ h join opens_ o
        on h.script_id = o.script_id and o.outer_ = h.depth and o.pos > h.pos group by 1, 2)"""
    return statement(
        [*ctes, bodies, open_, matched],
        """select h.script_id, h.pos, form, name, has_superclass, cast(count(m.pos) as int) as member_count from heads_ h
           left join body_ b on h.script_id = b.script_id and h.pos = b.pos
           left join mth m on m.script_id = b.script_id and m.is_method and m.brace.pos = b.body_pos
           group by all""",
    )


def _constructs_ctes(corpus: str) -> list[str]:
    ctes = [*chain(corpus, "asi"), enclosing("asi"), *_DECLARATORS, *method_ctes("dc"),
            _CONTROL[0].replace("<SRC>", "mth"), _CONTROL[1], _CONTROL[2], _CHAIN.replace("<SRC>", "cf")]
    name = f"case when kind in {NAMES} then text end"
    no = "null::varchar"
    rows = {
        "import": (f"{_kw('IMPORT')} and n1 in {in_list(S.NAMES + ['{', '*', 'STRING'])}", no),
        "export": (_kw("EXPORT"), no),
        "var_decl": ("declares", name),
        "function": (_kw("FUNCTION"), f"case when n1 in {NAMES} then n1t when n1 = '*' and n2 in {NAMES} then n2t end"),
        "arrow": ("kind = '=>'", no),
        "class": (_kw("CLASS"), f"case when n1 in {NAMES} then n1t end"),
        "method": ("is_method", "mname"),
        "call": (_IS_CALL, _CALLEE),
        "member": (f"({_DOTTED} or {_COMPUTED})", "case when kind = '.' then n1t end"),
        "literal": ("kind in ('NUMBER', 'STRING', 'REGEX', 'TRUE', 'FALSE', 'NULL', 'UNDEFINED')", "text"),
        "template": ("kind in ('TEMPLATE_NO_SUB', 'TEMPLATE_HEAD')", no),
        "identifier": ("kind = 'IDENTIFIER'", "text"),
        "yield": (_kw("YIELD"), no),
        "spread_or_rest": ("kind = '...'", no),
    }
    parts = [f"case when {c} then {{'node': {q(n)}, 'name': {v}}} end" for n, (c, v) in rows.items()]
    parts.append(f"case when ({_OPERATOR}) is not null then {{'node': {_OPERATOR}, 'name': lower(kind)}} end")
    parts.append(f"case when construct is not null then {{'node': construct, 'name': {no}}} end")
    ctes.append(
        f"""nodes as (select script_id, pos, n_.node as node, n_.name as name from (select script_id, pos,
            unnest(list_filter([{', '.join(parts)}], lambda r: r is not null)) as n_ from chn))"""
    )
    return ctes


def nodes() -> dict[str, str]:
    out = {
        "imports": statement(_imports_ctes("code"), _import_select()),
        "exports": statement(_exports_ctes("code"), _export_select()),
        "classes": _classes(),
    }
    decl = [*chain("code", "asi"), enclosing("asi"), *_DECLARATORS]
    out["var_decls"] = statement(
        decl,
        f"""select script_id, pos, decl_kind, case when kind in {NAMES} then text end as name, kind in ('{{', '[') as is_pattern,
            coalesce(case when kind in ('{{', '[') then after else n1 end = '=', false) as has_initializer from dc where declares""",
    )
    out["functions"] = statement(
        chain("code", "asi"),
        f"""select f.script_id, f.pos, function_form as form,
            case when n1 = '*' then case when n2 in {NAMES} then n2t end when n1 in {NAMES} then n1t end as name,
            coalesce(n1 = '*', false) as generator, coalesce(p1 = 'ASYNC', false) as is_async, h.items as param_count, f.depth
            from (select *, pos + 1 + case when n1 = '*' then case when n2 in {NAMES} then 2 else 1 end when n1 in {NAMES} then 1 else 0 end as open_at from asi where {_kw('FUNCTION')}) f
            left join (select script_id, pos, items from asi) h on h.script_id = f.script_id and h.pos = f.open_at""",
    )
    out["arrows"] = statement(
        chain("code", "br"),
        """select a.script_id, a.pos, coalesce(case when a.p1 <> ')' then a.p2 = 'ASYNC' else o.p1 = 'ASYNC' end, false) as is_async,
           a.n1 <> '{' as expression_body, case when a.p1 <> ')' then 1 else o.items end as param_count, a.p1 <> ')' as single_identifier
           from br a left join br c on c.script_id = a.script_id and c.pos = a.pos - 1
           left join br o on o.script_id = c.script_id and o.pos = c.partner_pos where a.kind = '=>'""",
    )
    out["methods"] = statement([*chain("code", "cond"), *method_ctes("cond")], _methods_select())
    out["control_flow"] = statement(
        [*chain("code", "asi"), _CONTROL[0].replace("<SRC>", "asi"), _CONTROL[1], _CONTROL[2]],
        "select script_id, pos, construct from cf where construct is not null",
    )
    out["calls"] = statement(
        [*chain("code", "br"), _CHAIN.replace("<SRC>", "br"),
         "cc as (select *, lag(chain_) over (partition by script_id order by pos) as link_ from chn)"],
        f"""select script_id, pos, {_CALLEE} as callee, coalesce(link_.p1 = 'NEW', false) as is_new,
            coalesce(cast(floor((pos - 1 - link_.pos) / 2) as int), 0) as member_depth, coalesce(items, 0) as arg_count from cc where {_IS_CALL}
            union all select script_id, pos, text, true, cast(floor((pos - chain_.pos) / 2) as int), 0 from chn
            where part and chain_.p1 = 'NEW' and kind <> '.' and coalesce(n1, '') not in ('(', '.', '[', 'TEMPLATE_NO_SUB', 'TEMPLATE_HEAD')""",
    )
    out["member_access"] = statement(
        chain("code", "nb"),
        f"select script_id, pos, case when {_DOTTED} then n1t end as property, {_COMPUTED} as computed from nb where {_DOTTED} or {_COMPUTED}",
    )
    out["operators"] = statement([*decl, *_operand_ctes()], "select script_id, pos, operator, cls as operator_class, left_start, right_end from op_left join op_right using (script_id, pos)")
    out["templates"] = statement(
        chain("code", "br"),
        f"""select t.script_id, t.pos, coalesce(t.p1 in {in_list(OPERAND_END)}, false) as tagged,
            cast(case when t.kind = 'TEMPLATE_NO_SUB' then 0 else 1 + (select count(*) from br m where m.script_id = t.script_id and m.kind = 'TEMPLATE_MIDDLE'
              and m.level = t.level and m.pos > t.pos and m.pos < t.partner_pos) end as int) as substitutions
            from br t where t.kind in ('TEMPLATE_NO_SUB', 'TEMPLATE_HEAD')""",
    )
    tree = [*decl, *_PATTERN_TREE]
    out["patterns"] = statement(
        tree,
        """select b.script_id, b.pos, case b.kind when '{' then 'object' else 'array' end as shape, b.position, b.items as item_count, b.nesting, b.path,
             coalesce(b.after = '=', false) as has_default,
             cast(count(*) filter (i.what = 'name') as int) as names, cast(count(*) filter (i.what <> 'hole' and i.has_default) as int) as defaults,
             cast(count(*) filter (i.what = 'hole') as int) as holes, cast(count(*) filter (i.shorthand) as int) as shorthands,
             cast(count(*) filter (i.what <> 'hole' and i.computed) as int) as computed_keys
           from pt_all b left join pt_items i on i.script_id = b.script_id and i.parent_pos = b.pos group by all
           union all
           select script_id, pos, 'element', case when in_pattern or param then 'rest' else 'spread' end, null, null, null, null, 0, 0, 0, 0, 0
           from (select f.*, t.pos is not null and f.parent.kind in ('[', '{') as in_pattern from pt_facts f left join pt_tree t on t.script_id = f.script_id and t.pos = f.parent.pos)
           where kind = '...'""",
    )
    out["pattern_bindings"] = statement(
        tree,
        """select script_id, pos, text as name, root_pos, position, path || step as path, what as target, has_default, coalesce(p1 = '...', false) as is_rest, shorthand, computed
           from pt_items where what in ('name', 'member')""",
    )
    out["generators_async"] = statement(
        [*chain("code", "asi"),
         """lv as materialized (select script_id, pos, kind, n1, asi_standard, conditional, is_open, is_close, open_p1, body_of_std, partner_pos,
              depth + case when is_open then -1 when is_close then 1 else 0 end as on_ from asi)""",
         """ends_ as (select script_id, on_, pos, kind = ':' and coalesce(conditional, false) as colon,
              sum(case when kind = '?' then 1 when kind = ':' and conditional then -1 else 0 end) over (partition by script_id, on_ order by pos) as bal, kind, n1, asi_standard, is_close from lv)""",
         """ends2_ as materialized (select * from ends_ where colon or kind in (',', ';', ':', 'TEMPLATE_MIDDLE', 'EOF') or is_close or asi_standard is not null)""",
         """ex as (select a.script_id, a.pos + 1 as body_pos, min(t.pos) as close_pos from ends_ a left join ends2_ t on t.script_id = a.script_id and t.on_ = a.on_ and t.pos > a.pos
              and (not t.colon or t.bal + 1 = a.bal or t.asi_standard is not null) where a.kind = '=>' and a.n1 <> '{' group by 1, 2)""",
         """fb as (select script_id, pos as body_pos, partner_pos as close_pos from lv where kind = '{'
              and ((open_p1 = ')' and coalesce(body_of_std, '') <> 'control') or open_p1 = '=>') union all select * from ex)""",
         f"""uses_ as (select script_id, pos, case when {_kw('YIELD')} then case when n1 = '*' then 'yield*' else 'yield' end
              when {_kw('AWAIT')} then case when p1 = 'FOR' then 'for await' else 'await' end end as construct from asi)"""],
        """select u.script_id, u.pos, u.construct, max(f.body_pos) as body_pos from uses_ u left join fb f
           on f.script_id = u.script_id and f.body_pos <= u.pos and coalesce(f.close_pos, 2147483647) > u.pos
           where u.construct is not null group by 1, 2, 3""",
    )
    out["feature_stage"] = statement(
        [*decl],
        f"""select script_id, max(cast(kind in ('[', '{{') and (declares or coalesce(after = '=' and is_open, false)) as int)) as destructuring,
            max(cast(kind = '=>' as int)) as arrows, max(cast(starts_with(kind, 'TEMPLATE') as int)) as templates,
            max(cast({_kw('CLASS')} as int)) as classes,
            max(cast(kind in ('ASYNC', 'AWAIT', 'YIELD', '...') or (kind = 'IDENTIFIER' and text = 'of' and coalesce(encl.p1 = 'FOR', false)) as int)) as iteration_async,
            max(cast({_kw('IMPORT', 'EXPORT')} as int)) as modules from dc group by 1""",
    )
    out["nesting_stats"] = statement(
        chain("code", "asi"),
        """select script_id, max(depth) as max_depth, avg(depth) as avg_depth, count(*) as n_tokens,
           cast(count(*) filter (kind = ';') + count(*) filter (asi_standard is not null) as bigint) as n_statements,
           count(*) / greatest(count(*) filter (kind = ';') + count(*) filter (asi_standard is not null), 1) as tokens_per_statement from asi group by 1""",
    )
    out["nesting_quantiles"] = statement(
        chain("code", "asi"),
        """select [quantile_disc(d, 0.5), quantile_disc(d, 0.9), quantile_disc(d, 0.99)] as depth_quantiles,
           [quantile_disc(n, 0.5), quantile_disc(n, 0.9), quantile_disc(n, 0.99)] as token_quantiles, max(n) as longest
           from (select script_id, cast(max(depth) as bigint) as d, count(*) as n from asi group by 1)""",
    )
    out["node_census"] = statement(
        _constructs_ctes("code"),
        """select node, ext, cast(sum(n) as bigint) as n_nodes, count(*) as n_scripts, cast(grouping(node, ext) as bigint) as level from
           (select n.script_id, node, lower(ext) as ext, count(*) as n from nodes n join scripts using (script_id) group by 1, 2, 3) group by cube(node, ext)""",
    )
    out["visit"] = statement(
        _constructs_ctes("code"),
        """select count(*) as n_nodes, count(distinct node) as n_kinds, count(distinct script_id) as n_scripts,
           count(*) filter (node = 'call') as n_calls, max(length(name)) as longest_name from nodes""",
    )
    out["module_edges"] = statement(["recursive " + c if i == 0 else c for i, c in enumerate(_edges_ctes())], "select * from edges")
    edges_ = ["recursive " + c if i == 0 else c for i, c in enumerate(_edges_ctes())]
    out["module_reach"] = statement(
        edges_
        + ["""walk(src, dst, depth) as (select distinct path, target_path, 1 from edges where status <> 'external'
              union select w.src, e.target_path, w.depth + 1 from walk w join (select distinct path, target_path from edges where status <> 'external') e on e.path = w.dst where w.depth < (select count(*) from scripts))"""],
        "select src, dst, cast(min(depth) as int) as depth from walk group by 1, 2",
    )
    closure = edges_ + [
        "link_ as materialized (select distinct path, target_path from edges where status <> 'external')",
        "pair_(src, dst) as (select * from link_ union select p.src, l.target_path from pair_ p join link_ l on l.path = p.dst)",
        "module_ as (select path from link_ union select target_path from link_)",
    ]
    out["module_components"] = statement(
        closure + ["both_ as (select a.src, a.dst from pair_ a join pair_ b on a.src = b.dst and a.dst = b.src)",
                   "comp_ as (select path, coalesce(min(dst), path) as component, min(dst) is not null as cyclic from module_ left join both_ on src = path group by path)"],
        "select path, component, count(*) over (partition by component) as size, cyclic from comp_",
    )
    out["module_reach_sizes"] = statement(
        closure, "select path, count(dst) as n_reached from module_ left join pair_ on src = path group by path")
    return out


def _edges_ctes() -> list[str]:
    resolve = """case when regexp_matches(source, '^\\.\\.?/') then
        case when len(folders_) - ups_ > 0 then array_to_string(folders_[1:len(folders_) - ups_], '/') || '/' else '' end
        || regexp_replace(source, '^(?:\\./|(?:\\.\\./)+)', '') end"""
    where = """string_split(path, '/')[1:len(string_split(path, '/')) - 1] as folders_,
        length(regexp_extract(source, '^((?:\\.\\./)*)', 1)) // 3 as ups_"""
    return [
        *chain("gen", "asi"), enclosing("asi"), clause_cte("enc"), _SOURCE.replace("<SRC>", "cl"), *_DECLARATORS,
        _SOURCE.replace("<SRC>", "dc").replace("src_ as", "esrc_ as", 1),
        f"imp_ as ({_import_select()})",
        f"exp_ as ({_export_select().replace('from src_', 'from esrc_')})",
        f"want_ as (select *, {resolve} as target_path from (select i.*, path, {where} from imp_ i join scripts using (script_id)))",
        "target_ as (select path as target_path, max(script_id) as target_id from scripts group by 1)",
        "named_ as (select script_id, exported, min(pos) as export_pos from exp_ where exported is not null group by 1, 2)",
        f"""star_ as (select distinct s.script_id as target_id, t.target_id as star_id from
            (select script_id, {resolve} as star_path from (select e.*, path, {where} from exp_ e join scripts using (script_id) where is_all and alias is null)) s
            join target_ t on t.target_path = s.star_path)""",
        """hops_(target_id, star_id) as (select target_id, star_id from star_
            union select h.target_id, s.star_id from hops_ h join star_ s on s.target_id = h.star_id)""",
        """edges as materialized (select w.script_id, w.pos, w.path, w.local, w.imported, w.source, w.target_path,
            coalesce(case when n.export_pos is null then b.star_id end, t.target_id) as target_script,
            case when w.target_path is null then 'external' when t.target_id is null then 'missing' when w.imported is null then 'module'
                 when n.export_pos is not null then 'resolved' when b.star_id is not null then 'resolved_star' else 'unresolved' end as status
            from want_ w left join target_ t using (target_path)
            left join named_ n on n.script_id = t.target_id and n.exported = w.imported
            left join (select s.target_id, n2.exported, min(s.star_id) as star_id from hops_ s join named_ n2 on n2.script_id = s.star_id
                       where n2.exported <> 'default' group by 1, 2) b on b.target_id = t.target_id and b.exported = w.imported)""",
    ]


# --- logs and traces -----------------------------------------------------------------------------------------


def _log() -> str:
    cols = C.log_line_columns()
    return f"log as (select {cols['line_no']} as line_no, {cols['text']} as text from events where event_type = 'error')"


def _entries(pattern: str, text: str) -> str:
    part = "nullif(regexp_extract(t, {0}, {1}), '')"
    return f"""select line_no, {part.format(q(pattern), 1)} as path, try_cast({part.format(q(pattern), 2)} as int) as line,
        try_cast({part.format(q(pattern), 3)} as int) as col, trim({part.format(q(pattern), 4)}) as message, not regexp_matches(t, {q(pattern)}) as _bad
        from (select line_no, {text} as t from log where trim(text) <> '')"""


_FILES = "files as (select path, size from scripts where cast(script_id[2:] as bigint) % 7 <> 3)"


def logs() -> dict[str, str]:
    category = "case " + " ".join(f"when contains(message, {q(c)}) then {q(c)}" for c in CATEGORIES) + " else 'other' end"
    msg = f"""msg as (select line_no, message, {category} as category from (select line_no, t[instr(t, ': ') + 2:] as message, t
        from (select line_no, trim(text) as t from log)) where instr(t, ': ') > 0 and length(message) > 0)"""
    lazy, strict = _entries(LAZY_LINE, "trim(text)"), _entries(STRICT_LINE, "text")
    base = [_log(), msg]
    good = [_log(), f"good as (select * from ({lazy}) where not _bad)"]
    sized = [_log(), scripts("gen"), _FILES, f"ok as (select * exclude (_bad) from ({strict}) where not _bad)"]
    return {
        "read_error_log": statement([_log()], lazy),
        "error_category": statement(base, "select line_no, message, category from msg"),
        "error_type_counts": statement(
            base, "select message, count(*) as n, min(line_no) as first_line, count(*) * 100.0::double / sum(count(*)) over () as share from msg group by 1"
        ),
        "stream_error_counts": statement(
            base, "select message, category, count(*) as n, min(line_no) as first_line from msg group by 1, 2"
        ),
        "error_category_counts": statement(
            base, "select category, count(*) as n, count(*) * 100.0::double / sum(count(*)) over () as share from msg group by 1"
        ),
        "error_totals": statement(base, "select count(*) as total_errors, count(distinct message) as distinct_messages from msg"),
        "error_running": statement(base, "select line_no, message, count(*) over (order by line_no) as running from msg"),
        "log_with_size": statement(sized, "select path, line_no, line, col, message, size from ok join files using (path)"),
        "log_sorted_by_size": statement(
            sized,
            "select row_number() over (order by size desc, line_no desc) as rank, size, line_no, path, line, col, message from ok join files using (path)",
        ),
        "error_files": statement(good, "select distinct path from good"),
        "missing_files": statement(
            [*good, scripts("gen"), _FILES], "select distinct path from good where path not in (select path from files)"
        ),
        "offending_scripts": statement(
            [*good, scripts("gen")],
            """select basename, path, script_id, ext, size, src from (select regexp_extract(path, '[^/]*$') as basename, *,
               row_number() over (partition by regexp_extract(path, '[^/]*$') order by path desc) as rn from scripts where path in (select path from good)) where rn = 1""",
        ),
    }


def _trace_ctes() -> list[str]:
    order = ", ".join(C.TRACE_ORDER)
    split, dies, rename, reduced = (
        r"Splitting off stack (\d+) from (\d+)", r"Stack (\d+)", r"Rename stack (\d+) -> (\d+)", r"Reduced stack (\d+) by rule (\d+) \(line (\d+)\)",
    )

    def num(pattern: str, group: int) -> str:
        return f"try_cast(regexp_extract(t, {q(pattern)}, {group}) as int)"

    return [
        f"""lines_ as (select l_orderkey % 16 as trace_id, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by {order}) as line_no,
            {C.trace_line_text()} as text from lineitem)""",
        """kinds_ as (select *, case when starts_with(t, 'Next token is token') then 'next_token' when contains(t, 'Splitting off stack') then 'split'
            when contains(t, 'Stack ') and contains(t, 'dies') then 'die' when starts_with(t, 'Rename stack') then 'rename'
            when starts_with(t, 'Cleanup:') then 'cleanup' when starts_with(t, '[PASS]') or starts_with(t, '[FAIL]') then 'verdict'
            when starts_with(t, 'Reduced stack') then 'reduce' end as kind from (select *, trim(text) as t from lines_))""",
        f"""ev as (select trace_id, line_no, kind, case when kind = 'next_token' then regexp_split_to_array(t, '\\s+')[5] end as token,
            case kind when 'split' then {num(split, 1)} when 'die' then {num(dies, 1)} when 'rename' then {num(rename, 2)} when 'reduce' then {num(reduced, 1)} end as stack,
            case kind when 'split' then {num(split, 2)} when 'rename' then {num(rename, 1)} end as parent,
            case kind when 'reduce' then {num(reduced, 2)} end as rule, case kind when 'reduce' then {num(reduced, 3)} end as rule_line
            from kinds_ where kind is not null)""",
    ]


def traces() -> dict[str, str]:
    tokens_ = """st as (select * from (select *, nullif(last_value(case when kind = 'next_token' then coalesce(token, '') end ignore nulls) over
        (partition by trace_id order by line_no rows between unbounded preceding and 1 preceding), '') as current from ev) where kind = 'split')"""
    rules_ = """sr as (select s.trace_id, s.line_no, s.stack, s.parent, r.rule, r.rule_line
        from (select * from ev where kind = 'split' and stack is not null) s asof left join (select * from ev where kind = 'reduce' and stack is not null) r
        on s.trace_id = r.trace_id and s.parent = r.stack and s.line_no >= r.line_no)"""
    by_token = "bt as (select trace_id, current as token, count(*) as n, min(line_no) as first_line from st where current is not null group by 1, 2)"
    by_rule = "bru as (select trace_id, rule, rule_line, count(*) as n, min(line_no) as first_line from sr where rule is not null group by 1, 2, 3)"
    base = _trace_ctes()

    def top(table: str, k: int) -> str:
        return f"select *, cast(rn as int) as rank from (select *, row_number() over (partition by trace_id order by n desc, first_line) as rn from {table}) where rn <= {k}".replace(
            "select *, cast(rn as int) as rank", "select * exclude (rn), cast(rn as int) as rank"
        )

    def peak(kinds: str, select: str = "select trace_id, max(peak) as peak_alive from walk group by 1", extra: tuple = ()) -> str:
        return statement(
            ["recursive " + base[0], *base[1:], *extra,
             f"""se as materialized (select trace_id, kind, stack, parent, row_number() over (partition by trace_id order by line_no) as i from ev
                 where kind in {kinds} and (kind in ('cleanup', 'verdict') or (stack is not null and (kind = 'die' or parent is not null))))""",
             """walk(trace_id, i, live, peak) as (select distinct trace_id, 0::bigint, [0], 1 from ev union all
                select w.trace_id, w.i + 1, nl, case when e.kind = 'split' then greatest(w.peak, len(nl)) else w.peak end from (
                  select w.*, e.kind, case e.kind when 'split' then list_distinct(w.live || [e.stack]) when 'die' then list_filter(w.live, lambda x: x <> e.stack)
                    when 'rename' then case when list_contains(w.live, e.parent) then list_distinct(list_filter(w.live, lambda x: x <> e.parent) || [e.stack]) else w.live end
                    else []::int[] end as nl from walk w join se e on e.trace_id = w.trace_id and e.i = w.i + 1) w, lateral (select w.kind as kind) e)"""],
            select,
        )

    stream = """select trace_id, last_line, max_stack, peak_alive, coalesce(n_splits, 0) as n_splits, top_token, top_rule
        from (select trace_id, max(line_no) as last_line, coalesce(max(case when kind = 'split' then stack end), 0) as max_stack from ev
              where kind in ('next_token', 'reduce', 'die', 'rename', 'split') group by 1)
        join (select trace_id, max(peak) as peak_alive from walk group by 1) using (trace_id)
        left join (select trace_id, cast(sum(n) as bigint) as n_splits, arg_max(token, {'n': n, 'f': -first_line}) as top_token from bt group by 1) using (trace_id)
        left join (select trace_id, arg_max(rule || '@' || rule_line, {'n': n, 'f': -first_line}) as top_rule from bru group by 1) using (trace_id)"""
    # the line-by-line analyzer counts only splits whose numbers it could read
    read_tokens = tokens_.replace("where kind = 'split')", "where kind = 'split' and stack is not null)")
    return {
        "stream_trace": peak("('split', 'die', 'rename')", stream, (read_tokens, rules_, by_token, by_rule)),
        "read_trace": statement(base, "select * from ev"),
        "split_tokens": statement([*base, tokens_], "select trace_id, line_no, stack, current as token from st"),
        "split_parent_rule": statement([*base, rules_], "select * from sr"),
        "splits_by_token": statement([*base, tokens_, by_token], "select * from bt"),
        "splits_by_rule": statement([*base, rules_, by_rule], "select * from bru"),
        "topk_split_tokens": statement([*base, tokens_, by_token], top("bt", 10)),
        "topk_split_rules": statement([*base, rules_, by_rule], top("bru", 5)),
        "trace_max_stack": statement(
            base, "select trace_id, coalesce(max(case when kind = 'split' then stack end), 0) as max_stack from ev group by 1"
        ),
        "trace_compare": peak(
            "('split', 'die', 'rename', 'cleanup', 'verdict')",
            """select measure, name, n_a, n_b, n_b - n_a as delta from (
                 select measure, name, cast(coalesce(sum(n) filter (trace_id = 0), 0) as bigint) as n_a, cast(coalesce(sum(n) filter (trace_id = 1), 0) as bigint) as n_b from (
                   select trace_id, 'token' as measure, token as name, n from bt union all
                   select trace_id, 'rule', rule || '@' || rule_line, n from bru union all
                   select trace_id, 'max_stack', null, coalesce(max(case when kind = 'split' then stack end), 0) from ev group by 1 union all
                   select trace_id, 'peak_alive', null, max(peak) from walk group by 1)
                 where trace_id in (0, 1) group by 1, 2)""",
            (tokens_, rules_, by_token, by_rule),
        ),
        "trace_peak_alive": peak("('split', 'die', 'rename', 'cleanup', 'verdict')"),
        "trace_peak_unbroken": peak("('split', 'die', 'rename')"),
    }


def all_statements() -> dict[str, str]:
    return {**lexical(), **structural(), **checks(), **nodes(), **logs(), **traces()}
