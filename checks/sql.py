"""Checking SQL: the same results worked out set-wise in another engine.

Structure is found here by exploding tokens and running windows over them, which
is a different way from the in-row scans of the library.
"""

from __future__ import annotations

from checks import inputs as I

WS = "' ' || chr(9) || chr(13) || chr(10)"

FILES = f"files as (select *, substr(path, length(project) + 2) as rel from ({I.CODE_FILES}))"

# The inputs use two raw literal tags, so no back-reference is needed here.
LITERALS = r"""R"x\(.*?\)x"|R"html\(.*?\)html"|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''"""

STRIPPED = rf"""stripped as (
  select *, array_to_string(list_transform(
      regexp_extract_all(content, '(?s){LITERALS}|//[^\n]*|/\*.*?\*/|[^R"''/]+|.'),
      lambda t: case when starts_with(t, '//') then ''
        when starts_with(t, '/*') then regexp_replace(t, '[^\n]', '', 'g') else t end), '') as s
  from files)"""

LINES = """lines as (
  select project, path, unnest(string_split(s, chr(10))) as line,
    unnest(range(len(string_split(s, chr(10))))) as n from stripped)"""

INCLUDES = r"""includes as (
  select project, path, n, regexp_extract(line, '^[ \t\r]*#[ \t\r]*include[ \t\r]*(?:<([^>]*)>|"([^"]*)")', 1)
      || regexp_extract(line, '^[ \t\r]*#[ \t\r]*include[ \t\r]*(?:<([^>]*)>|"([^"]*)")', 2) as header
  from lines where regexp_matches(line, '^[ \t\r]*#[ \t\r]*include[ \t\r]*(?:<[^>]*>|"[^"]*")')),
headers as (
  select project, path, list(header order by n) as headers
  from (select project, path, header, min(n) as n from includes group by all) group by all)"""

# The head of a type.
HEAD = (
    r"(?:template\s*<[^;{]*>\s*)*(?:\[\[[^\]]+\]\]\s*)*\b(class|struct)\s+([A-Za-z_]\w*)[^;{]*\{"
)

HEADS = f"""heads as (
  select project, path, i, regexp_extract(head, '{HEAD}', 1) as keyword, regexp_extract(head, '{HEAD}', 2) as name,
    cast(sum(length(gap) + length(head)) over (partition by path order by i) - 1 as bigint) as open,
    ends_with(trim(gap, {WS}), 'enum') as after_enum
  from (select project, path, unnest(hs) as head, unnest(gaps[1:len(hs)]) as gap, unnest(range(len(hs))) as i
    from (select project, path, regexp_extract_all(s, '{HEAD}') as hs, regexp_split_to_array(s, '{HEAD}') as gaps
      from stripped) where len(hs) > 0))"""

PAIRS = rf"""tokens as (
  select project, path, unnest(ts) as t, unnest(range(len(ts))) as i
  from (select project, path, regexp_extract_all(s, '(?s){LITERALS}|[{{}}]|[^R"''{{}}]+|.') as ts from stripped)),
braces as (
  select *, sum(case t when '{{' then 1 else -1 end) over (partition by path order by pos) as depth
  from (select *, cast(sum(length(t)) over (partition by path order by i) - 1 as bigint) as pos from tokens)
  where t in ('{{', '}}')),
pairs as (
  select * from (
    select project, path, t, pos as open, level, lead(pos) over (partition by path, level order by pos) as close
    from (select *, case t when '{{' then depth else depth + 1 end as level from braces))
  where t = '{{' and close is not null)"""

BODIES = """bodies as (
  select h.project, h.path, h.open, p.close, h.keyword, h.name
  from heads h join pairs p on h.path = p.path and h.open = p.open where not h.after_enum)"""

PIECES = r"""pieces as (
  select project, path, open, keyword, unnest(cs) as c, unnest(range(len(cs))) as i
  from (select b.*, regexp_extract_all(substr(s, b.open + 2, b.close - b.open - 1), '[^(){};]*[(){};]') as cs
    from bodies b join stripped using (project, path))),
steps as (
  select *, right(c, 1) as e,
    sum(case right(c, 1) when '{' then 1 when '}' then -1 else 0 end) over w as bs,
    sum(case right(c, 1) when '(' then 1 when ')' then -1 else 0 end) over w as ps
  from pieces window w as (partition by path, open order by i)),
clamped as (
  select *, bs - least(0, min(bs) over w) as b, ps - least(0, min(ps) over w) as p
  from steps window w as (partition by path, open order by i)),
ends as (
  select *, coalesce(lag(b) over w, 0) as b0 from clamped window w as (partition by path, open order by i)),
flushes as (
  select *, (e = ';' and b = 0) or (e = '{' and b = 1 and b0 = 0 and p = 0) as flush from ends),
segments as (
  select *, coalesce(sum(case when flush or (e = '}' and b = 0) then 1 else 0 end)
      over (partition by path, open order by i rows between unbounded preceding and 1 preceding), 0) as seg
  from flushes),
labels as (
  select *, case when row_number() over (partition by path, open, seg order by i) = 1 and b0 = 0
      then regexp_extract(c, '^(?:[ \t\r\n]*(?:public|private|protected)[ \t\r\n]*:)*') else '' end as label
  from segments),
levels as (
  select *, coalesce(last_value(nullif(regexp_extract(label, '(public|private|protected)[ \t\r\n]*:$', 1), '') ignore nulls)
      over (partition by path, open order by i),
      case keyword when 'struct' then 'public' else 'private' end) as access,
    substr(c, length(label) + 1) as rest
  from labels)"""

STATEMENTS = f"""statements as (
  select project, path, open, max(i) as i, last(access order by i) as access,
    trim(string_agg(rest, '' order by i), {WS}) as statement
  from levels group by project, path, open, seg having bool_or(flush))"""

# What a statement that is no method begins with; below, tails of methods and control words.
NOT_METHOD = (
    "^(using |typedef |friend |enum |class |struct |static_assert|if[ (]|for[ (]|while[ (]|switch[ (]"
    "|return |catch |else|#)"
)

METHODS = rf"""checked as (
  select *, regexp_matches(statement, '{NOT_METHOD}') as filtered,
    instr(statement, '(') > 0 and instr(statement, ')') > 0 and last_close > instr(statement, '(')
      and not contains(statement, '(*') and not contains(statement, '(&')
      and regexp_matches(tail, '^(|;|\{{|= default;|= delete;|= 0;|(?s:(const|noexcept|override|final|requires|->|&).*))$')
      and regexp_matches(name, '^[A-Za-z_~]')
      and name not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'sizeof', 'alignof', 'decltype', 'requires')
      as method
  from (select *, length(statement) - instr(reverse(statement), ')') + 1 as last_close,
      trim(substr(statement, length(statement) - instr(reverse(statement), ')') + 2), {WS}) as tail,
      regexp_extract(trim(split_part(statement, '(', 1), {WS}), '[^ \t*&:]*$') as name
    from statements)),
methods as (
  select * from checked where access = 'public' and statement <> '' and not filtered and method)"""

CLASSES = """per_class as (
  select b.project, b.path, b.open, b.name,
    coalesce(list(m.statement order by m.i) filter (where m.i is not null), []) as public_methods
  from bodies b left join methods m on b.path = m.path and b.open = m.open group by all),
classes as (
  select project, path, list({'name': name, 'public_methods': public_methods} order by open) as classes
  from per_class group by all)"""

ANALYSIS = """analysis as (
  select f.project, f.path, coalesce(h.headers, []) as headers, coalesce(c.classes, []) as classes, '' as parse_error
  from files f left join headers h using (project, path) left join classes c using (project, path))"""

STEPS = {
    "files": FILES,
    "stripped": STRIPPED,
    "lines": LINES,
    "headers": INCLUDES,
    "heads": HEADS,
    "pairs": PAIRS,
    "bodies": BODIES,
    "levels": PIECES,
    "statements": STATEMENTS,
    "methods": METHODS,
    "classes": CLASSES,
    "analysis": ANALYSIS,
}


def upto(step: str, select: str) -> str:
    """A query over all steps up to and including the named one."""
    names = list(STEPS)
    return "with " + ",\n".join(STEPS[n] for n in names[: names.index(step) + 1]) + "\n" + select


MARK = r"^[ \t\r#*_>-]*\[(SUMMARY|ISSUES|SUGGESTIONS|ERROR|SKIPPED)\][ \t\r*_]*:?[ \t\r*_]*$"

REVIEWS = rf"""reviews as (
  select *, coalesce(raw_status, case when starts_with(ai_analysis, '[ERROR]') then 'error' else 'generated' end) as ai_status
  from ({I.REVIEW_RESULTS})),
flagged as (
  select *, ai_status = 'error' or starts_with(ai_analysis, '[ERROR]') as is_error,
    ai_status = 'skipped' or starts_with(ai_analysis, '[SKIPPED]') as is_skipped, ai_status = 'cached' as is_cached
  from reviews),
review_lines as (
  select project, path, doc_id, unnest(string_split(ai_analysis, chr(10))) as line,
    unnest(range(len(string_split(ai_analysis, chr(10))))) as n from reviews),
fences as (
  select *, starts_with(trim(line, {WS}), {I.FENCE}) as is_fence,
    sum(case when starts_with(trim(line, {WS}), {I.FENCE}) then 1 else 0 end) over (partition by doc_id order by n) % 2 = 1 as fenced
  from review_lines),
marked as (
  select *, case when not fenced then nullif(regexp_extract(line, '{MARK}', 1), '') end as mark from fences),
blocks as (
  select *, count(mark) over (partition by doc_id order by n) as block from marked),
first_marks as (
  select doc_id, mark, min(block) as block from blocks where mark is not null group by all),
section_text as (
  select f.doc_id, f.mark, trim(coalesce(string_agg(b.line, chr(10) order by b.n), ''), {WS}) as body
  from first_marks f left join blocks b on f.doc_id = b.doc_id and f.block = b.block and b.mark is null group by all),
sections as (
  select r.*, coalesce(a.body, '') as summary, coalesce(b.body, '') as issues, coalesce(c.body, '') as suggestions
  from flagged r left join section_text a on a.doc_id = r.doc_id and a.mark = 'SUMMARY'
    left join section_text b on b.doc_id = r.doc_id and b.mark = 'ISSUES'
    left join section_text c on c.doc_id = r.doc_id and c.mark = 'SUGGESTIONS'),
issue_lines as (
  select doc_id, regexp_replace(regexp_replace(l, '^[ \t\r\n#*_>-]*[ \t\r\n.):`0-9]*', ''), '[ \t\r\n.:;*`_]+$', '') as plain
  from (select doc_id, unnest(string_split(issues, chr(10))) as l from sections)),
has_issues as (
  select doc_id, bool_or(plain <> '' and lower(plain) not in ('none', 'no issues', 'no major issues',
    'no critical issues', 'no obvious issues', 'no significant issues')) as has_issues
  from issue_lines group by doc_id),
graded as (
  select s.*, h.has_issues and not is_error and not is_skipped as has_issues,
    case when is_error or rule_text <> '' or (h.has_issues and not is_error and not is_skipped) then 'PROBLEM'
      when is_skipped or suggestions <> '' then 'IMPROVE' else 'GOOD' end as verdict
  from sections s join has_issues h using (doc_id))"""


def reviews(select: str) -> str:
    return f"with {REVIEWS}\n{select}"


DECIDED = f"""manifest as ({I.MANIFEST}),
run_files as (select *, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as file_hash
  from ({I.RUN_FILES})),
prev_all as ({I.previous_select(f"sha256({I.NORMAL_TEXT})")}),
prev as (select * from prev_all qualify row_number() over (partition by project, path order by pos desc) = 1),
joined as (
  select m.project, m.path, m.pos, f.path is not null as exists_here, f.file_hash, f.mtime, f.text,
    p.path is not null as prev_found, p.ai_status as prev_status, p.ai_analysis as prev_analysis, p.file_hash as prev_hash,
    f.path is not null and p.path is not null and p.ai_status not in ('error', 'skipped')
      and not starts_with(p.ai_analysis, '[ERROR]')
      and case when p.file_hash is not null then p.file_hash = f.file_hash
        else f.mtime <= (select count(*) from documents) / 2 end as reuse
  from manifest m left join run_files f using (project, path) left join prev p using (project, path)),
decided as (
  select *, case when not exists_here then 'error' when reuse then 'cached'
    when project = 'src3' or project = 'src4' then 'skipped' else 'pending' end as action from joined),
rules as (
  select *, list_filter([
    case when contains(text, 'new ') and not contains(text, 'delete') then 'Possible memory leak: ''new'' used without ''delete''' end,
    case when contains(text, 'malloc') and not contains(text, 'free') then 'Possible memory leak: ''malloc'' used without ''free''' end,
    case when contains(text, 'while(true)') or contains(text, 'for(;;)') then 'Potential infinite loop detected' end],
    lambda x: x is not null) as issues from decided),
results as (
  select project, path, pos, action, case when action = 'pending' then 'generated' else action end as ai_status,
    case when action = 'error' then [] else issues end as issues,
    case action when 'error' then '[ERROR]' || chr(10) || 'File not found on disk.'
      when 'cached' then coalesce(prev_analysis, '')
      when 'skipped' then '[SKIPPED]' || chr(10) || 'AI analysis was skipped because the cooldown window is still active.'
        || chr(10) || chr(10) || 'Next AI run is available in about 34 seconds.'
      else '[SUMMARY]' || chr(10) || 'Rule review of ' || path || '.' || chr(10) || chr(10) || '[ISSUES]' || chr(10)
        || case when len(issues) = 0 then 'None' else array_to_string(list_transform(issues, lambda i: '- ' || i), chr(10)) end
        || chr(10) || chr(10) || '[SUGGESTIONS]' || chr(10)
        || case when len(issues) = 0 then '' else 'Resolve the rule findings.' end end as ai_analysis,
    case when action = 'error' then '' else file_hash end as file_hash
  from rules)"""


def decided(select: str) -> str:
    return f"with {DECIDED}\n{select}"
