"""The catalogue's queries as SQL for DuckDB, written apart from the Spark code."""

from voxtab.fixtures import NOW, with_views

# As in functions.text, in the spelling of RE2.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
STRIP = rf"'\A[{WS}]+|[{WS}]+\z', '', 'g'"
ESTIMATE = "cast(ceil(duration_sec / 15.1e0) * 5 + 45 as bigint)"
LIVE = "status in ('pending', 'processing')"
FINISHED = "status in ('completed', 'error', 'quarantined')"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def garbage(text: str) -> str:
    head = f"substring({text}, 1, 1000)"
    alnum = rf"length(regexp_replace({head}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return (
        f"(case when {alnum} < 50 then true "
        f"else cast({alnum} as double) / nullif(length({head}), 0) < 2e-1 end)"
    )


def words_in(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{WS}]+'))"


def span(seconds: str) -> str:
    day = f"({seconds} // 86400)"
    rest = f"({seconds} % 86400)"
    clock = (
        f"cast({rest} // 3600 as varchar) || ':' || "
        f"lpad(cast({rest} % 3600 // 60 as varchar), 2, '0') || ':' || "
        f"lpad(cast({rest} % 60 as varchar), 2, '0')"
    )
    return (
        f"case when {day} = 0 then '' when {day} = 1 then '1 day, ' "
        f"else cast({day} as varchar) || ' days, ' end || {clock}"
    )


def eta(ts: str, seconds: str) -> str:
    return f"strftime({ts} + to_seconds({seconds}), {STAMP}) || ' UTC'"


AHEAD = f"""
instants as (
  select created_at, sum(processing_time_est) as own from jobs where {LIVE} group by created_at),
sums as (
  select created_at, sum(own) over (order by created_at rows unbounded preceding) - own as ahead from instants),
waiting as (
  select j.*, cast(s.ahead as bigint) as ahead_sec
  from jobs j join sums s on j.created_at = s.created_at where {LIVE})"""

EXTENSION = r"regexp_extract(filename, '(?s)(?:^|/)\.*[^./][^/]*?(\.[^./]*)\z', 1)"

def squashed(source: str) -> str:
    """CTEs that end in `squashed` (id, text): of `source` (id, t) with words said four or more times in
    a row said once. Runs of equal words are cut in fours from the left; a run of three more counts if
    the next word begins with it, of which the copies in front go. A word that gave some is no
    run's first any more."""
    word = r"[\p{L}\p{N}_]+"
    return rf"""
cut_up as materialized (
  select id, t, regexp_extract_all(t, '{word}') as w, regexp_split_to_array(t, '{word}') as g from {source}),
words as materialized (
  select id, i, w[i] as word, g[i] as gap, regexp_full_match(g[i], '[{WS}]+') and i > 1 as spaced
  from (select *, unnest(range(1, len(w) + 1)) as i from cut_up)),
numbered as (
  select *, sum(case when same then 0 else 1 end) over (partition by id order by i) as run
  from (select *, coalesce(spaced and word = lag(word) over (partition by id order by i), false) as same from words)),
runs as (
  select r.id, r.s, r.e, r.word, case when n.spaced and starts_with(n.word, r.word)
    then length(n.word) - length(regexp_replace(n.word, '^(?:' || r.word || ')+', '')) else 0 end as front
  from (select id, min(i) as s, max(i) as e, any_value(word) as word from numbered group by id, run having count(*) > 2) r
  left join words n on n.id = r.id and n.i = r.e + 1),
listed as materialized (select *, row_number() over (partition by id order by s) as k from runs),
walked as (
  select id, k, s as first, e, front, (e - s + 1) % 4 = 3 and front > 0 as over from listed where k = 1
  union all
  select l.id, l.k, l.s + case when w.over and w.e + 1 = l.s then 1 else 0 end, l.e, l.front,
    (l.e - l.s + 1 - case when w.over and w.e + 1 = l.s then 1 else 0 end) % 4 = 3 and l.front > 0
  from walked w join listed l on l.id = w.id and l.k = w.k + 1),
gone as (
  select id, unnest(range(first, e + 1)) as i, first, e, over, 0 as front from walked where e - first > 2 or over
  union all select id, e + 1, first, e, over, front from walked where over),
kept as (
  select w.id, w.i, case when d.id is null then w.gap || w.word
      when d.front > 0 then substr(w.word, d.front + 1)
      when (w.i - d.first) % 4 = 0 or w.i > d.e - (d.e - d.first + 1) % 4 and not d.over then w.gap || w.word
      else '' end as piece
  from words w left join gone d on d.id = w.id and d.i = w.i),
joined as (select id, string_agg(piece, '' order by i) as body from kept group by id),
squashed as (
  select c.id, coalesce(j.body, '') || c.g[len(c.w) + 1] as text from cut_up c left join joined j on j.id = c.id)"""


VALID_GUID = (
    "coalesce(regexp_full_match(replace(trim(replace(replace(guid, 'urn:', ''), 'uuid:', ''), '{}'), '-', ''),"
    " '[0-9A-Fa-f]{32}'), false)"
)

ADMITTED = f"""
own as (
  select *, case when not has_file then 'No file part' when filename = '' then 'No selected file'
      when guid is null or guid = '' then 'GUID is required'
      when not {VALID_GUID} then 'Invalid GUID format. Must be a valid UUID v4' end as bad
  from submissions),
checked as (
  select o.*, case when bad is not null then bad
      when guid in (select guid from jobs) then 'GUID already exists'
      when row_number() over (partition by guid, bad is null order by arrival) > 1 then 'GUID already exists'
      else 'admitted' end as reason
  from own o),
admitted as (
  select *, {ESTIMATE} as processing_time_est from checked where reason = 'admitted')"""


def fold(start: str = "0") -> str:
    """CTEs up to `folded`; `start` is the attempt counter a guid begins with."""
    return f"""
counted as (
  select e.*, {start} as g0, {start} + sum(case when outcome = 'garbage' then 1 else 0 end)
    over (partition by e.guid order by seq rows unbounded preceding) as g
  from job_events e),
marked as (
  select *, outcome in ('completed', 'error') or (outcome = 'garbage' and g >= 3) as is_last from counted),
stops as (
  select guid, min(seq) filter (where is_last) as t from marked group by guid),
kept as (
  select m.*, row_number() over (partition by m.guid order by seq desc) as back
  from marked m join stops s on m.guid = s.guid where s.t is null or m.seq <= s.t),
folded as (
  select guid,
    case when outcome in ('completed', 'error') then outcome when outcome = 'garbage' and g >= 3 then 'quarantined'
      when outcome = 'started' then 'processing' else 'pending' end as status,
    cast(case when outcome = 'completed' then 0 else g end as int) as attempt_count,
    seq as last_seq, case when is_last then ts end as completed_at,
    cast(g - g0 as int) as garbage_results,
    outcome <> 'completed' and g - g0 - case when outcome = 'garbage' and g >= 3 then 1 else 0 end > 0 as cleared
  from kept where back = 1)"""


CONFIDENCE = """
sized as (
  select *, case when word_start is not null and word_end is not null then word_end - word_start
    else (seg_end - seg_start) / count(*) over (partition by guid, pass_index, seg_index) end as len
  from words)"""


def confidence(by: str) -> str:
    counts = "probability > 0"
    total = f"sum(len) filter (where {counts})"
    return (
        f"select {by}, case when {total} > 0 then "
        f"sum(len * probability) filter (where {counts}) / {total} else 0e0 end as confidence "
        f"from sized group by {by}"
    )


SCORES = """
rated as (
  select *, case when duration_sec > 0 then word_count / duration_sec else 0e0 end as wps from scores),
scored as (
  select *, case when wps < 1.4e0 then confidence * (wps / 1.4e0) else confidence end as adjusted,
    duration_sec > 5 and word_count < floor(duration_sec / 4) as suspiciously_short
  from rated),
ranked as (
  select g.guid, p.pass_index, coalesce(s.confidence, 0e0) as confidence, coalesce(s.adjusted, 0e0) as adjusted,
    row_number() over (partition by g.guid order by coalesce(s.adjusted, 0e0) desc, p.pass_index) as rank_no
  from (select distinct guid from scored) g cross join (values (0), (1), (2), (3), (4)) p(pass_index)
  left join scored s on g.guid = s.guid and p.pass_index = s.pass_index),
best as (select * from ranked where rank_no = 1)"""

WORD_SCORES = f"""{CONFIDENCE},
scores as (
  select c.guid, c.pass_index, c.confidence, n.word_count, d.duration_sec
  from ({confidence('guid, pass_index')}) c
  join (select guid, pass_index, count(*) as word_count from words group by guid, pass_index) n
    on c.guid = n.guid and c.pass_index = n.pass_index
  join durations d on c.guid = d.guid), {SCORES}"""

CHOSEN = f"""{CONFIDENCE},
tidy as (
  select * from (select guid, pass_index, seg_index, seg_start, seg_end, regexp_replace(text, {STRIP}) as text
    from pass_segments) where text <> ''),
scores as (
  select coalesce(n.guid, c.guid) as guid, coalesce(n.pass_index, c.pass_index) as pass_index,
    coalesce(c.confidence, 0e0) as confidence, coalesce(n.word_count, 0) as word_count,
    coalesce(d.duration_sec, 0e0) as duration_sec
  from (select guid, pass_index, sum({words_in('text')}) as word_count from tidy group by guid, pass_index) n
  full join ({confidence('guid, pass_index')}) c on c.guid = n.guid and c.pass_index = n.pass_index
  left join durations d on d.guid = coalesce(n.guid, c.guid)), {SCORES},
chosen as (
  select t.* from tidy t join best b on t.guid = b.guid and t.pass_index = b.pass_index)"""

SPEAKERS = """
ran as (select guid from diarized where diarized),
heard as (select guid, count(distinct speaker) as n from turns group by guid),
speakers as (
  select j.guid, case when r.guid is null then 1 else coalesce(h.n, 0) end as n_speakers
  from jobs j left join ran r on j.guid = r.guid left join heard h on j.guid = h.guid)"""


def refined(segments: str, words: str) -> str:
    return f"""
matched as (
  select s.guid, s.seg_index, arg_min(w.word_start, w.word_index) as first_start,
    arg_max(w.word_end, w.word_index) as last_end
  from {segments} s join {words} w on s.guid = w.guid and w.word_start between s.seg_start and s.seg_end
  group by s.guid, s.seg_index),
refined as (
  select s.*, coalesce(m.first_start, s.seg_start) as refined_start, coalesce(m.last_end, s.seg_end) as refined_end
  from {segments} s left join matched m on s.guid = m.guid and s.seg_index = m.seg_index)"""


TIDY = f"""
tidy as (
  select * from (select guid, seg_index, regexp_replace(text, {STRIP}) as text, seg_start, seg_end from segments)
  where text <> '')"""

SQL: dict[str, str] = {}


def oracle(name: str, views: str, parts: str, select: str) -> None:
    """Views of the fixtures, further CTEs, final select."""
    sql = with_views("", *views.split())
    head = f"{sql.rstrip()}, {parts.strip()}" if sql and parts else sql or f"with {parts.strip()}"
    SQL[name] = f"{head.rstrip()} {select.strip()}" if head.strip() != "with" else select.strip()


oracle("status_report", "jobs", AHEAD, f"""
select guid, case when {LIVE} then status when status in ('completed', 'processed') then 'completed' else 'error' end as status,
  case when status in ('completed', 'processed') then '' end as transcription,
  case when status in ('error', 'quarantined') then 'Transcription failed'
    when status = 'processing' then 'Transcription is currently in progress' end as message,
  {eta('created_at', 'ahead_sec + processing_time_est')} as estimated_completion_utc,
  cast(null as varchar) as error,
  cast(case when status in ('completed', 'processed') then 0 end as int) as n_timings
from (select guid, status, created_at, processing_time_est, ahead_sec from waiting
  union all select guid, status, created_at, processing_time_est, null from jobs where not {LIVE})""")
oracle("wait_ahead", "jobs", AHEAD, "select guid, ahead_sec from waiting")
oracle("list_jobs", "jobs", "", """
select guid, filename, status, created_at as submitted_at, '' as completed_at, processing_time_est
from jobs order by created_at desc, guid""")
oracle("lookup_jobs", "jobs submissions", "", """
select a.guid, j.guid is not null as found, j.status, j.created_at, j.processing_time_est
from (select distinct guid from submissions) a left join jobs j on a.guid = j.guid""")
oracle("status_counts", "jobs", "", "select status, count(*) as n_jobs from jobs group by status")
oracle("in_flight_jobs", "jobs", "", f"select guid, status, created_at from jobs where {LIVE}")
oracle("backlog", "jobs", "", """
select cast(coalesce(sum(processing_time_est), 0) as bigint) as backlog_sec from jobs where status = 'pending'""")
oracle("queue_summary", "jobs", """
summed as (select count(*) as total_pending, cast(coalesce(sum(processing_time_est), 0) as bigint) as total_wait_sec
  from jobs where status = 'pending')""", f"""
select total_pending, total_wait_sec, {span('total_wait_sec')} as total_wait from summed""")
oracle("wait_texts", "jobs", AHEAD, f"select guid, {span('ahead_sec')} as wait from waiting")
oracle("monitor_eta", "jobs", "", f"""
select guid, filename, created_at as submitted_at, {eta('created_at', 'processing_time_est')} as estimated_completion_utc
from jobs where status = 'pending'""")
oracle("next_pending", "jobs", "", """
select guid, filename, created_at from jobs where status = 'pending' order by created_at, guid limit 20""")
oracle("estimate_check", "jobs", "", f"select guid, {ESTIMATE} as estimate_sec from jobs")

oracle("admission", "jobs submissions", ADMITTED, "select arrival, guid, reason from checked")
oracle("guid_validity", "submissions", "", f"select arrival, {VALID_GUID} as valid from submissions")
oracle("admission_eta", "jobs submissions", ADMITTED + """,
queued as (
  select *, cast(coalesce(sum(processing_time_est) over (order by arrival rows between unbounded preceding and 1 preceding), 0)
    + (select coalesce(sum(processing_time_est), 0) from jobs where status = 'pending') as bigint) as ahead_sec
  from admitted)""", f"""
select arrival, guid, processing_time_est, ahead_sec,
  {eta(f"timestamp '{NOW}'", 'ahead_sec + processing_time_est')} as estimated_completion_utc from queued""")
oracle("append_new_jobs", "jobs submissions", ADMITTED, f"""
select guid, filename, status, created_at, processing_time_est, attempt_count from jobs
union all
select guid, filename, 'pending', timestamp '{NOW}', processing_time_est, cast(0 as int) from admitted""")
oracle("evolve_job_schema", "jobs", "", """
select guid, filename, status, created_at, cast(null as timestamp) as completed_at,
  processing_time_est, cast(0 as int) as attempt_count from jobs""")

# A guid is free from the start, from its job's completion on, or never.
oracle("guarded_stream", "submissions jobs", f"""
asked as (select guid, arrival, arrival * 100 as at from submissions where {VALID_GUID}),
free as (select guid, greatest(date_diff('millisecond', timestamp '{NOW}', created_at + interval 1 day), case when {FINISHED} then 0
    when {LIVE} and processing_time_est % 3 = 0 then processing_time_est % 1000 * 100 else 1000000000000000 end) as since from jobs),
fits as (select a.guid, min(a.at) as first from asked a left join free f on a.guid = f.guid
  where f.guid is null or a.at >= f.since group by a.guid)""", """
select a.guid, a.arrival, case when a.at = f.first then 'admitted' else 'GUID already exists' end as reason
from asked a left join fits f on a.guid = f.guid""")

oracle("lifecycle_fold", "job_events", fold(), "select * from folded")
oracle("apply_outcomes", "jobs job_events", fold(
    "coalesce((select j.attempt_count from jobs j where j.guid = e.guid), 0)"), """
select j.guid, coalesce(f.status, j.status) as status, coalesce(f.attempt_count, j.attempt_count) as attempt_count,
  f.completed_at, cast(null as varchar) as transcription
from jobs j left join folded f on j.guid = f.guid and j.status in ('pending', 'processing')""")
SQL["stored_outcomes"] = SQL["apply_outcomes"]
oracle("stored_admissions", "jobs submissions", ADMITTED, f"""
select guid, filename, status, created_at, processing_time_est, attempt_count from jobs
where not ({FINISHED} and created_at <= timestamp '{NOW}' - interval 1 day)
union all
select guid, filename, 'pending', timestamp '{NOW}', processing_time_est, cast(0 as int) from admitted""")
oracle("recover_stuck", "jobs", "", """
select guid, case when status = 'processing' then 'pending' else status end as status, attempt_count from jobs""")
oracle("stuck_count", "jobs", "", "select count(*) as recovered from jobs where status = 'processing'")
oracle("expire_jobs", "jobs", "", f"""
select guid, status, created_at, {FINISHED} and created_at <= timestamp '{NOW}' - interval 1 day as expired from jobs""")
oracle("expired_artifacts", "jobs", f"""
gone as (select guid, {EXTENSION} as ext from jobs
  where {FINISHED} and created_at <= timestamp '{NOW}' - interval 1 day)""", """
select guid, 'original' as kind, guid || ext as path from gone
union all select guid, 'processed', guid || '_processed.mp3' from gone
union all select guid, 'transcript', guid || '.txt' from gone
union all select guid, 'aligned', guid || '_aligned' from gone
union all select guid, 'corpus', guid || '_corpus' from gone
union all select guid, 'aligner_input', guid || '_mfa_input' from gone""")

oracle("clean_segments", "segments", TIDY, "select guid, seg_index, text, seg_start, seg_end from tidy")
oracle("assemble_transcript", "segments", TIDY + """,
joined as (select guid, string_agg(text, ' ' order by seg_index) as transcript from tidy group by guid)""", f"""
select guid, transcript, cast({words_in('transcript')} as int) as word_count from joined""")
SQL["garbage_flags"] = f"select doc_id, {garbage('text')} as garbage from documents"

SQL["squash_repeated_words"] = (
    f"with recursive src as (select doc_id as id, text as t from documents),{squashed('src')} "
    "select id as doc_id, text from squashed"
)
oracle("alignment_text", "segments", TIDY + f""",
src as (select guid as id, string_agg(text, ' ' order by seg_index) as t from tidy group by guid),{squashed('src')}""", """
select id as guid, text from squashed""")
SQL["alignment_text"] = SQL["alignment_text"].replace("with ", "with recursive ", 1)

oracle("pass_fan_out", "jobs", "", """
select j.guid, p.* from jobs j cross join (values
  (0, 2e-1, 3e0, 5, true), (1, 0e0, 2.8e0, 7, true), (2, 0e0, 2.5e0, 1, true),
  (3, 3e-1, 3.2e0, 10, true), (4, 2e-1, 3.5e0, 15, false)
) p(pass_index, temperature, patience, beam_size, condition_on_previous_text)""")
oracle("pass_confidence", "words", CONFIDENCE, f"""
select guid, pass_index, round(confidence + 1e-9, 6) as confidence from ({confidence('guid, pass_index')})""")
oracle("segment_confidence", "words", CONFIDENCE, f"""
select guid, pass_index, seg_index, round(confidence + 1e-9, 6) as confidence
from ({confidence('guid, pass_index, seg_index')})""")
oracle("adjusted_confidence", "words durations", WORD_SCORES, """
select guid, pass_index, word_count, duration_sec, round(wps + 1e-9, 6) as wps, round(adjusted + 1e-9, 6) as adjusted,
  suspiciously_short from scored""")
oracle("best_pass", "words durations", WORD_SCORES, """
select guid, pass_index, round(confidence + 1e-9, 6) as confidence, round(adjusted + 1e-9, 6) as adjusted from best""")
oracle("best_segments", "pass_segments words durations", CHOSEN, """
select guid, pass_index, seg_index, seg_start, seg_end, text from chosen""")

oracle("speaker_counts", "jobs turns diarized", SPEAKERS, "select guid, n_speakers from speakers")
oracle("alignment_gate", "jobs turns diarized", SPEAKERS, """
select guid, n_speakers, n_speakers <= 1 as refine from speakers""")
oracle("jobs_to_align", "jobs aligned_words", "", """
select guid, status from jobs where guid not in (select guid from aligned_words)""")
oracle("alignment_words", "aligned_words", "", """
select guid, word_index, word_start, word_end, word from aligned_words where guid not like '%7'""")
oracle("align_words", "segments aligned_words", "", """
select s.guid, s.seg_index, w.word_index, w.word_start, w.word from segments s left join aligned_words w
on s.guid = w.guid and w.word_start between s.seg_start and s.seg_end""")
oracle("refine_segments", "segments aligned_words", refined("segments", "aligned_words"), """
select guid, seg_index, text, round(refined_start + 1e-9, 6) as refined_start, round(refined_end + 1e-9, 6) as refined_end
from refined""")
oracle("corrupt_flags", "segments", TIDY + """,
joined as (select guid, string_agg(text, ' ' order by seg_index) as text from tidy group by guid)""", f"""
select guid, guid like '%5' or {garbage('text')} as corrupt from joined""")
oracle("timings_json", "segments", TIDY, """
select guid, cast(row_number() over (partition by guid order by seg_index) - 1 as int) as pos,
  round(seg_start, 6) as start_sec, round(seg_end, 6) as end_sec, text from tidy""")

LOUDNESS = """
samples as (select guid, seq, sample_rate, cast(unnest(samples) as double) as x from frames),
sums as (
  select guid, count(*) as n_samples, sqrt(avg(x * x)) as rms, max(sample_rate) as rate from samples group by guid),
gains as (
  select *, case when rms > 0 then 20 * log10(rms) end as dbfs,
    coalesce(-20 - case when rms > 0 then 20 * log10(rms) end, 0e0) as gain_db from sums),
factors as (select *, pow(10e0, gain_db / 20) as factor from gains),
scaled as (
  select s.guid, s.seq, least(greatest(s.x * f.factor, -1e0), 1e0) as x from samples s join factors f on s.guid = f.guid)"""
oracle("loudness", "frames", LOUDNESS + """,
noise as (select guid, avg(abs(x)) as energy from scaled group by guid)""", """
select f.guid, n_samples, round(dbfs + 1e-9, 6) as dbfs, round(gain_db + 1e-9, 6) as gain_db, round(factor + 1e-9, 6) as factor,
  round_even(n_samples / rate * 1000, 0) / 1000 as duration_sec, round(energy + 1e-9, 6) as noise_energy,
  energy > 1.5e-2 as needs_denoise
from factors f join noise n on f.guid = n.guid""")
oracle("normalized_frames", "frames", LOUDNESS, """
select guid, seq, cast(count(*) as int) as n, round(sum(abs(cast(cast(x as float) as double))), 3) as level
from scaled group by guid, seq""")
oracle("resolve_audio", "jobs listing", """
have as (select guid, bool_or(kind = 'original') as original, bool_or(kind = 'processed') as processed
  from listing group by guid)""", f"""
select j.guid, coalesce(h.original, false) as audio_found,
  case when h.original then case when h.processed then j.guid || '_processed.mp3' else j.guid || {EXTENSION} end end as audio_path
from jobs j left join have h on j.guid = h.guid""")

oracle("job_batch", "jobs listing pass_segments words durations turns diarized aligned_words",
       SPEAKERS + "," + CHOSEN + """,
single as (select w.* from aligned_words w where guid in (select guid from speakers where n_speakers <= 1)),""" +
       refined("chosen", "single") + """,
texts as (
  select guid, string_agg(text, ' ' order by seg_index) as transcription, count(*) as n,
    arg_min(refined_start, seg_index) as first_start, arg_max(refined_end, seg_index) as last_end
  from refined group by guid),
have as (select guid, bool_or(kind = 'original') as original from listing group by guid),
outcomes as (
  select j.guid, j.attempt_count, t.transcription, t.n, t.first_start, t.last_end,
    case when not coalesce(h.original, false) then 'error'
      when """ + garbage("coalesce(t.transcription, '')") + """ or coalesce(t.n, 0) = 0 then
        case when j.attempt_count + 1 >= 3 then 'quarantined' else 'pending' end
      else 'completed' end as status
  from jobs j left join have h on j.guid = h.guid left join texts t on j.guid = t.guid
  where j.status = 'pending')""", f"""
select j.guid, coalesce(o.status, j.status) as status,
  cast(case when o.status is null or o.status = 'error' then j.attempt_count when o.status = 'completed' then 0
    else j.attempt_count + 1 end as int) as attempt_count,
  case when o.status in ('completed', 'error', 'quarantined') then timestamp '{NOW}' end as completed_at,
  case when o.status = 'completed' then o.transcription end as transcription,
  cast(case when o.status = 'completed' then o.n end as int) as n_timings,
  round(case when o.status = 'completed' then o.first_start end, 6) as first_start,
  round(case when o.status = 'completed' then o.last_end end, 6) as last_end
from jobs j left join outcomes o on j.guid = o.guid""")

# Streams: a table is one batch, so states of finished jobs whose day is over at the
# final watermark (a day behind the newest event) have left.
LIVE_STATES = fold() + """,
ends as (select guid, min(ts) + interval 1 day as due from job_events group by guid),
mark as (select max(ts) - interval 1 day as upto from job_events),
states as (
  select f.* from folded f join ends e on f.guid = e.guid cross join mark
  where f.completed_at is null or e.due > mark.upto)"""
oracle("lifecycle_stream", "job_events", LIVE_STATES, """
select guid, status, attempt_count, last_seq, completed_at from states""")
oracle("dedupe_stream", "submissions", "", f"select distinct guid from submissions where {VALID_GUID}")
oracle("monitor_stream", "jobs job_events", fold() + """,
totals as (
  select count(*) as total_pending, cast(coalesce(sum(j.processing_time_est), 0) as bigint) as total_wait_sec
  from folded f left join jobs j on f.guid = j.guid where f.status = 'pending')""", f"""
select total_pending, total_wait_sec, {span('total_wait_sec')} as total_wait from totals""")
