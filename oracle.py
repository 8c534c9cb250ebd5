"""Expected results of the registered queries as DuckDB SQL over the test tables."""

from __future__ import annotations

import fixtures as X

# Fixed values, on their own here so that an error in those of the package shows:
# short forms of words in hospital names, and column name patterns by field in their order.
NAME_WORDS = {'baylor': 'bsw',
 'scott': 'bsw',
 'white': 'bsw',
 'ascension': 'asc',
 'seton': 'asc',
 'cedar': 'cp',
 'park': 'cp',
 'regional': 'reg',
 'medical': 'med',
 'center': 'ctr',
 'hospital': 'hosp',
 'health': 'hlth',
 'system': 'sys',
 'emergency': 'er',
 'campus': 'campus',
 'georgetown': 'gtown'}
FIELD_PATTERNS = {'description': ('description', 'service_description', 'procedure_description',
                 'item_description', 'charge_description', 'cpt_description', 'service',
                 'procedure'),
 'cash_price': ('standard_charge|discounted_cash', 'discounted_cash', 'cash_price', 'self_pay',
                'selfpay', 'cash_discount', 'discounted_price',
                'standard_charge_discounted_cash', 'cash', 'de_identified_minimum'),
 'gross_charge': ('standard_charge|gross', 'gross', 'gross_charge', 'standard_charge',
                  'charge_amount', 'list_price', 'standard_charge_gross', 'gross_price'),
 'negotiated_min': ('standard_charge|min', 'min', 'minimum', 'negotiated_min', 'min_negotiated',
                    'deidentified_min', 'de_identified_min', 'standard_charge_min',
                    'min_price'),
 'negotiated_max': ('standard_charge|max', 'max', 'maximum', 'negotiated_max', 'max_negotiated',
                    'deidentified_max', 'de_identified_max', 'standard_charge_max',
                    'max_price'),
 'setting': ('setting', 'patient_setting', 'care_setting', 'service_setting', 'location',
             'place_of_service')}

FACILITY_OF_SUPPLIER = "concat('bsw-', substr(concat('s', cast(s_suppkey as varchar)), 1, 4), '-med-ctr')"


def duck(sql: str) -> str:
    return sql.format(**X.DUCKDB)


def price(text: str) -> str:
    bare = f"trim(translate({text}, '$,', ''))"
    return (
        f"(case when regexp_full_match({bare}, "
        r"'\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"and try_cast({bare} as double) > 0 then try_cast({bare} as double) end)"
    )


def dec(expr: str) -> str:
    return f"cast({expr} as decimal(12,2))"


def code_type(text: str) -> str:
    name = f"upper(trim({text}))"
    return (
        f"(case when coalesce({name}, '') = '' then 'unknown' else case {name} "
        "when 'CPT' then 'HCPCS' when 'REV' then 'RC' when 'ICD10' then 'ICD-10' "
        f"when 'ICD10CM' then 'ICD-10-CM' when 'ICD10PCS' then 'ICD-10-PCS' else {name} end end)"
    )


STANDARD = "('CPT', 'HCPCS', 'ICD-10', 'ICD-10-CM', 'ICD-10-PCS', 'RC')"

# Charge lines with their facility; one facility per supplier.
SUPPLIER_LINES = f"""
charges as ({duck(X.RAW_CHARGES)}),
lines as (
  select c.*, {FACILITY_OF_SUPPLIER} as facility_id,
    concat('s', cast(s_suppkey as varchar), '.csv') as source_file
  from charges c
)
"""
# The same with one facility per nation, as in the price files.
FILE_LINES = f"""
charges as ({duck(X.RAW_CHARGES)}),
lines as (
  select c.*, concat('bsw-n', cast(s_nationkey as varchar), '-med-ctr') as facility_id,
    cast(s_nationkey as varchar) as source_file
  from charges c join supplier using (s_suppkey)
)
"""
TYPED = f"""
typed as (
  select *, {price('cash')} as cash_price, {price('gross')} as gross_charge,
    {price('neg_min')} as negotiated_min, {price('neg_max')} as negotiated_max,
    lower(trim(setting)) as setting_name,
    {code_type('code_1_type')} as type_1, trim(code_1) as c1, trim(code_2) as c2,
    {code_type('code_1_type')} in {STANDARD} as has_1, code_2 <> 'N/A' as has_2
  from lines
),
coded as (
  select *,
    case when has_1 and has_2 and type_1 = 'RC' then concat('{{"RC":["', c1, '","', c2, '"]}}')
      when has_1 and has_2
        then concat('{{"', type_1, '":["', c1, '"],"RC":["', c2, '"]}}')
      when has_1 then concat('{{"', type_1, '":["', c1, '"]}}')
      when has_2 then concat('{{"RC":["', c2, '"]}}') else '{{}}' end as codes_key,
    case when has_1 and type_1 = 'RC' then c1 when has_2 then c2 end as rc_code,
    case when has_1 and type_1 = 'HCPCS' then c1 end as hcpcs_code,
    concat_ws(',', case when not (has_1 or has_2) then 'no_standard_code' end,
      case when cash_price is null then 'missing_cash_price' end,
      case when setting_name not in ('', 'outpatient') then 'not_outpatient' end) as reasons
  from typed
)
"""


def best(source: str = "coded where reasons = ''") -> str:
    return f"""
ranked as (
  select *,
    row_number() over (partition by facility_id, description, codes_key
      order by cash_price desc, source_file, l_orderkey, line_position) as rn,
    min(negotiated_min) over (partition by facility_id, description, codes_key) as low,
    max(negotiated_max) over (partition by facility_id, description, codes_key) as high
  from {source}
),
best as (
  select facility_id, description, codes_key, rc_code, hcpcs_code, cash_price, gross_charge,
    low as negotiated_min, high as negotiated_max, source_file, l_orderkey, line_position
  from ranked where rn = 1
)
"""


HOSPITALS = f"""
hospitals as (
  select {FACILITY_OF_SUPPLIER} as facility_id, facility_name,
    trim(split_part(address, ',', 2)) as city,
    regexp_extract(trim(split_part(address, ',', 3)), '\\b([A-Z]{{2}})\\b', 1) as state,
    address, concat('supplier/', cast(s_suppkey as varchar)) as source_url,
    '2.0.0' as file_version, '2025-01-01' as last_updated,
    timestamp '2025-01-01 00:00:00' + to_minutes(cast(s_suppkey as integer)) as ingested_at
  from ({duck(X.FACILITIES)})
)
"""
CHARGES_TO_BEST = "with " + ",".join([SUPPLIER_LINES, TYPED, best()])
OPERATIONS = "with " + ",".join([SUPPLIER_LINES, TYPED, best(), HOSPITALS])
FILE_BEST = "with " + ",".join([FILE_LINES, TYPED, best()])

OP_COLUMNS = (
    "facility_id, description, codes_key, rc_code, hcpcs_code, "
    + ", ".join(f"{dec(p)} as {p}" for p in X.PRICES)
)
MONEY = lambda p: f"case when {p} is null then 'N/A' else concat('$', cast({dec(p)} as varchar)) end"


def facility_id(name: str) -> str:
    words = (
        f"string_split(trim(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9\\s-]', '', 'g'),"
        " '\\s+', ' ', 'g')), ' ')"
    )
    short = (
        "case w "
        + " ".join(f"when '{k}' then '{v}'" for k, v in NAME_WORDS.items())
        + " else substr(w, 1, 4) end"
    )
    parts = f"list_transform({words}, lambda w: {short})"
    distinct = f"list_filter({parts}, lambda p, i: list_position({parts}, p) = i)"
    joined = f"regexp_replace(array_to_string({distinct}, '-'), '-+', '-', 'g')"
    return f"trim({joined}, '-')"


def title(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, ' '), "
        "lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')"
    )


PATTERNS = ",".join(
    f"('{field}', {i}, '{p}')" for field, ps in FIELD_PATTERNS.items() for i, p in enumerate(ps)
)
HEADERS = f"""
headers as ({duck(X.HEADERS)}),
columns as (
  select file, i - 1 as pos, columns[i] as col,
    replace(lower(columns[i]), ' ', '_') as name
  from headers, lateral (select unnest(range(1, len(columns) + 1)) as i)
),
patterns(field, priority, pattern) as (values {PATTERNS}),
per_file as (
  select file, name, min(pos) as first_pos, max(pos) as pos, arg_max(col, pos) as col
  from columns group by file, name
),
words as (
  select name, field, priority, pattern, name = pattern as exact,
    list_distinct(string_split(name, '_')) as cw, list_distinct(string_split(pattern, '_')) as pw
  from (select distinct name from columns), patterns
),
scored as (
  select *, cast(floor((cast(len(list_intersect(pw, cw)) as double)
      / cast(len(list_distinct(list_concat(pw, cw))) as double) * 0.7::double
    + cast(len(list_filter(pw, lambda w: len(list_filter(cw, lambda c: contains(c, w))) > 0))
      as double) / cast(len(pw) as double) * 0.3::double) * 100.0::double) as integer) as score
  from words
),
matches as (
  select *, row_number() over (partition by file, field order by
    case when exact then 0 else 1 end, case when exact then priority else -score end,
    priority, first_pos) as rn
  from per_file join scored using (name) where exact or score >= 80
),
roles as (
  select file, pos,
    case when regexp_matches(n, '^code[|_][0-9]+$') then regexp_extract(n, '([0-9]+)$', 1)
      when regexp_matches(n, '^code\\|[0-9]+\\|type$') or regexp_matches(n, '^code_[0-9]+_type$')
        then regexp_extract(n, '([0-9]+)', 1)
      when regexp_matches(n, '^billing_code(_type)?(_[0-9]+)?$')
        then nullif(regexp_extract(n, '(_[0-9]+)$', 1), '')
      when regexp_matches(n, '^(cpt|hcpcs|drg|icd10|rev|ndc)_code(_[0-9]+)?$')
        then replace(n, '_code', '')
      else '0' end as instance,
    case when regexp_matches(n, '^(cpt|hcpcs|drg|icd10|rev|ndc)_code') then false
      else contains(n, 'type') end as is_type,
    case when regexp_matches(n, '^(cpt|hcpcs|drg|icd10|rev|ndc)_code')
      then upper(split_part(n, '_', 1)) end as implied_type
  from (select file, pos, lower(col) as n from columns)
  where regexp_matches(n, '^(code[|_][0-9]+|code\\|[0-9]+\\|type|code_[0-9]+_type'
    || '|billing_code(_[0-9]+)?|billing_code_type(_[0-9]+)?'
    || '|(cpt|hcpcs|drg|icd10|rev|ndc)_code(_[0-9]+)?|code_information.*|code|code_type|type)$')
),
code_cols as (
  select file, instance, max(case when not is_type then pos end) as code_pos,
    max(case when is_type then pos end) as type_pos, max(implied_type) as implied_type
  from roles group by file, instance
  having max(case when not is_type then pos end) is not null
)
"""


def similar(queries: str, columns: str) -> str:
    return f"""
with cache as ({duck(X.QUERY_CACHE)}),
queries as ({queries}),
hits as (
  select query_id, id, user_query, confidence_score,
    list_cosine_similarity(cast(query_embedding as double[]), cast(query_vector as double[]))
      as similarity
  from cache, queries where confidence_score >= 0.90
),
ranked as (
  select *, row_number() over (partition by query_id order by similarity desc, id) as rank
  from hits where similarity > 0.2
)
select {columns}, round(similarity, 6) as similarity from ranked where rank <= 5
"""


def sql() -> dict[str, str]:
    ops = f"select {OP_COLUMNS} from best"
    file_ops = FILE_BEST + ops
    lines = "with " + ",".join([SUPPLIER_LINES, TYPED])
    keys = "l_orderkey as source_block, line_position as source_row"
    out = {}
    out["clean_prices"] = f"""{lines} select facility_id, {keys},
      {', '.join(f'{dec(p)} as {p}' for p in X.PRICES)} from typed"""
    out["code_types"] = f"""with {SUPPLIER_LINES}, types as (
        select code_1_type as code_type from lines union all select code_2_type from lines)
      select code_type, {code_type('code_type')} as canonical_type,
        upper({code_type('code_type')}) in {STANDARD} as is_standard, count(*) as n
      from types group by 1, 2, 3"""
    out["charge_codes"] = f"""{lines} select facility_id, {keys}, codes_key, rc_code, hcpcs_code
      from coded"""
    out["normalized_lines"] = f"""{lines} select facility_id, {keys}, description,
      setting_name as setting, {dec('coalesce(cash_price, 0)')} as cash_price, reasons from coded"""
    out["accepted_lines"] = f"""{lines} select facility_id, {keys}, description, codes_key,
      {dec('cash_price')} as cash_price from coded where reasons = ''"""
    out["accepted_lines_any_setting"] = f"""{lines} select facility_id, {keys}, description,
      codes_key, {dec('coalesce(cash_price, 0)')} as cash_price from coded where has_1 or has_2"""
    out["best_records"] = f"""{CHARGES_TO_BEST} select facility_id, description, codes_key,
      {', '.join(f'{dec(p)} as {p}' for p in X.PRICES)}, source_file from best"""
    out["operations"] = CHARGES_TO_BEST + ops
    out["facility_ids"] = f"""with names as ({duck(X.NAMES)}),
      ids as (select name, {facility_id('name')} as facility_id from names)
      select name, facility_id, regexp_full_match(facility_id, '[a-z0-9-]+') as is_valid from ids"""
    out["id_collisions"] = f"""with names as ({duck(X.NAMES)})
      select {facility_id('name')} as facility_id, count(*) as n_rows, min(name) as first_name,
        max(name) as last_name from names group by 1 having count(*) > 1"""
    stem = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
    middle = f"regexp_replace(regexp_replace({stem}, '^[^_]*_', ''), '_[^_]*$', '')"
    out["names_from_files"] = f"""with paths as ({duck(X.FILE_PATHS)})
      select path, concat('.', lower(split_part(path, '.', -1))) as extension,
        case when {stem} like '%\\_%\\_standardcharges' escape '\\'
          then {title(f"replace({middle}, '-', ' ')")}
          else {title(f"translate({stem}, '-_', '  ')")} end as name,
        case when contains({stem}, '_')
          then {title(f"replace(split_part({stem}, '_', 2), '-', ' ')")}
          else {title(f"translate({stem}, '-_', '  ')")} end as json_name from paths"""
    zip_state = r"'\b([A-Z]{2})\s+\d{5}'"
    n = "len(string_split(address, ','))"
    state_in = lambda x: f"nullif(regexp_extract({x}, '\\b([A-Z]{{2}})\\b', 1), '')"
    out["places"] = f"""with a as ({duck(X.ADDRESSES)}), b as (
      select *,
        case when {n} >= 3 then trim(split_part(address, ',', 2)) end as json_city,
        case when {n} >= 3 then {state_in("split_part(address, ',', 3)")} end as json_state,
        case when contains(location, ',') then trim(split_part(location, ',', 1)) end as loc_city,
        case when contains(location, ',')
          then {state_in("split_part(location, ',', 2)")} end as loc_state,
        case when {n} >= 3 then trim(split_part(address, ',', 2))
          when {n} = 2 then trim(split_part(address, ',', 1))
          else nullif(regexp_extract(regexp_extract(address, '^(.*?)\\s*\\b[A-Z]{{2}}\\s+\\d{{5}}', 1),
            '(\\S+)\\s*$', 1), '') end as adr_city,
        case when {n} >= 2 then {state_in("split_part(address, ',', -1)")}
          else nullif(regexp_extract(address, {zip_state}, 1), '') end as adr_state
      from a)
      select id, json_city, json_state,
        case when coalesce(loc_city, '') = '' then coalesce(adr_city, loc_city) else loc_city end
          as city,
        case when coalesce(loc_city, '') = '' then coalesce(adr_state, loc_state) else loc_state end
          as state from b"""
    shown = f"""facility_id, facility_name, description, codes_key,
      {', '.join(f'{dec(p)} as {p}' for p in X.PRICES)}, {MONEY('cash_price')} as cash_text,
      {MONEY('gross_charge')} as gross_text,
      concat({MONEY('negotiated_min')}, ' - ', {MONEY('negotiated_max')}) as negotiated_text"""
    joined = "best join hospitals using (facility_id)"
    order = "order by cash_price desc nulls first, facility_id, description, codes_key"
    out["top_operations"] = f"""{OPERATIONS} select {shown} from {joined}
      where description ilike '%ring%' and cash_price >= 500 and cash_price <= 90000
      {order} limit 10"""
    out["price_display"] = f"{OPERATIONS} select {shown} from {joined}"
    out["operations_in_price_range"] = f"""{CHARGES_TO_BEST} {ops}
      where cash_price >= 1000 and cash_price <= 20000"""
    out["description_search"] = f"{CHARGES_TO_BEST} {ops} where description ilike '%R_d%'"
    out["operations_of_facility"] = f"{CHARGES_TO_BEST} {ops} where facility_id = 'bsw-s1-med-ctr'"
    out["code_lookup"] = f"""{CHARGES_TO_BEST} {ops}
      where contains(codes_key, '"0476"')"""
    out["code_lookup_by_type"] = f"""{CHARGES_TO_BEST} {ops}
      where codes_key like '%"HCPCS":["32"]%'"""
    out["primary_code_lookup"] = f"""{CHARGES_TO_BEST} {ops}
      where hcpcs_code = '32' and rc_code = '0482'"""
    hospital_columns = """facility_id, facility_name, city, state, address, source_url,
      file_version, last_updated, ingested_at"""
    out["latest_hospitals"] = f"""with {HOSPITALS} select {hospital_columns} from hospitals
      order by ingested_at desc, facility_id limit 10"""
    out["latest_hospitals_of_state"] = f"""with {HOSPITALS} select {hospital_columns}
      from hospitals where state = 'TX' order by ingested_at desc, facility_id limit 10"""
    out["pricing_summary"] = f"""{OPERATIONS}, stored as (
        select facility_id, cast(cash_price as decimal(10,2)) as cash_price,
          cast(gross_charge as decimal(10,2)) as gross_charge from best)
      select h.facility_id, facility_name, city, state, count(s.facility_id) as total_operations,
        cast(sum(cash_price) as double) / count(cash_price) as avg_cash_price,
        min(cash_price) as min_cash_price, max(cash_price) as max_cash_price,
        cast(sum(gross_charge) as double) / count(gross_charge) as avg_gross_charge,
        last_updated, ingested_at
      from hospitals h left join stored s on h.facility_id = s.facility_id
      group by all"""
    out["orphan_operations"] = f"""{OPERATIONS} select facility_id, description, codes_key from best
      where facility_id not in (select facility_id from hospitals where state <> 'TX')"""
    gone = "(select facility_id from hospitals where state = 'TX')"
    out["purged_counts"] = f"""{OPERATIONS}
      select 'medical_operations' as table_name, count(*) as deleted_rows from best
        where facility_id in {gone}
      union all select 'hospitals', count(*) from hospitals where state = 'TX'"""
    out["operations_after_purge"] = f"""{OPERATIONS} {ops} where facility_id not in {gone}"""
    counters = """select source_file, count(*) as read_records,
        count(*) filter (reasons = '') as accepted_records,
        count(*) filter (reasons <> '') as failed_records,
        count(*) filter (contains(reasons, 'no_standard_code')) as no_standard_code,
        count(*) filter (contains(reasons, 'missing_cash_price')) as missing_cash_price,
        count(*) filter (contains(reasons, 'not_outpatient')) as not_outpatient
      from coded group by 1"""
    report = f"""counts as ({counters}),
      wins as (select source_file, count(*) as successful_records from best group by 1),
      report as (select c.*, coalesce(successful_records, 0) as successful_records,
        accepted_records - coalesce(successful_records, 0) as duplicate_records,
        coalesce(successful_records, 0) + failed_records as total_records
        from counts c left join wins w using (source_file))"""
    out["run_counts"] = f"{CHARGES_TO_BEST}, {report} select *, 0 as broken_records from report"
    totals = """select count(*) as files, cast(sum(total_records) as bigint) as total_records,
      cast(sum(successful_records) as bigint) as successful_records,
      cast(sum(failed_records) as bigint) as failed_records"""
    out["run_totals"] = f"{CHARGES_TO_BEST}, {report} {totals} from report"
    out["error_samples"] = f"""{lines}, r as (
        select source_file, reasons, row_number() over (partition by source_file
          order by l_orderkey, line_position) as n from coded where reasons <> '')
      select source_file, count(*) as n_errors,
        string_agg(reasons, '; ' order by n) filter (n <= 5) as errors,
        count(*) - count(*) filter (n <= 5) as more_errors from r group by 1"""
    out["hospital_rules"] = f"""with h as ({duck(X.HOSPITAL_CANDIDATES)})
      select id, concat_ws(',',
        {', '.join(f"case when {c} is null then '{c}_missing' end" for c in X.HOSPITAL_TEXTS)},
        case when not regexp_full_match(facility_id, '[a-z0-9-]+') then 'facility_id_format' end,
        case when not regexp_full_match(state, '[A-Z]{{2}}') then 'state_format' end,
        case when length(facility_id) > 255 then 'facility_id_too_long' end,
        case when length(facility_name) > 500 then 'facility_name_too_long' end,
        case when length(city) > 100 then 'city_too_long' end,
        case when length(state) > 2 then 'state_too_long' end,
        case when length(file_version) > 50 then 'file_version_too_long' end,
        case when length(last_updated) > 50 then 'last_updated_too_long' end) as broken_rules
      from h"""
    fits = lambda p: f"round({p}, 2) < 100000000"
    out["operation_rules"] = f"""with o as ({duck(X.OPERATION_CANDIDATES)})
      select id, concat_ws(',',
        case when facility_id is null then 'facility_id_missing' end,
        case when codes_key is null then 'codes_missing' end,
        case when description is null then 'description_missing' end,
        case when cash_price is null then 'cash_price_missing' end,
        case when gross_charge is null then 'gross_charge_missing' end,
        case when not regexp_full_match(facility_id, '[a-z0-9-]+') then 'facility_id_format' end,
        case when not regexp_full_match(currency, '[A-Z]{{3}}') then 'currency_format' end,
        {', '.join(f"case when {p} < 0 then '{p}_negative' end" for p in X.PRICES)},
        {', '.join(f"case when not {fits(p)} then '{p}_out_of_range' end" for p in X.PRICES)},
        case when negotiated_min > negotiated_max then 'negotiated_range' end,
        case when length(currency) > 3 then 'currency_too_long' end) as broken_rules from o"""
    out["cache_rules"] = f"""with c as ({duck(X.CACHE_CANDIDATES)})
      select id, concat_ws(',',
        case when user_query is null then 'user_query_missing' end,
        case when confidence_score is null then 'confidence_score_missing' end,
        case when query_embedding is null then 'query_embedding_missing' end,
        case when confidence_score not between 0 and 1 then 'confidence_range' end,
        case when len(query_embedding) <> 64 then 'embedding_dimension' end) as broken_rules
      from c"""
    out["cache_append"] = f"""with c as ({duck(X.CACHE_CANDIDATES)})
      select id, user_query, 0 as n_hcpcs_codes, 0 as n_rc_codes, '' as reasoning,
        cast(confidence_score as decimal(3,2)) as confidence_score,
        len(query_embedding) as dimension from c
      where user_query is not null and confidence_score between 0 and 1
        and len(query_embedding) = 64"""
    out["matched_columns"] = f"""with {HEADERS} select file, field, col as "column", pos, score, exact
      from matches where rn = 1"""
    out["name_scores"] = f"""with {HEADERS} select name, field, priority, pattern, score, exact
      from scored where exact or score >= 50"""
    out["code_columns"] = f"""with {HEADERS} select file, instance, code_pos, type_pos, implied_type
      from code_cols"""
    found = lambda f: f"coalesce(bool_or(field = '{f}'), false)"
    out["mapping_flags"] = f"""with {HEADERS}, m as (select * from matches where rn = 1),
      flags as (select h.file, {found('description')} as description,
        exists(select 1 from code_cols c where c.file = h.file) as has_codes,
        {found('cash_price')} or {found('gross_charge')} as has_price,
        {', '.join(f"{found(p)} as {p}" for p in X.PRICES)}
        from headers h left join m on m.file = h.file group by h.file)
      select *, concat_ws(',', case when not description then 'description' end,
        case when not has_codes then 'code columns' end,
        case when not has_price then 'pricing information' end) as missing_fields from flags"""
    first_line = "trim(split_part(head, chr(10), 1))"
    second_line = "trim(split_part(head, chr(10), 2))"
    kind = f"""case when {first_line} <> '' and {second_line} <> '' and json_valid({first_line})
      and json_valid({second_line}) then 'ndjson' else 'json' end"""
    sample = "substr(head, 1, 1024)"
    commas = f"""list_transform(list_slice(string_split({sample}, chr(10)), 1, 3),
      lambda x: length(x) - length(replace(x, ',', '')))"""
    out["detected_formats"] = f"""with heads as ({duck(X.HEADS)})
      select id, case when extension = '.csv' then 'csv'
        when extension in ('.ndjson', '.jsonl') then 'ndjson' when extension = '.json' then {kind}
        when contains({sample}, chr(10)) and len(list_distinct({commas})) = 1 and ({commas})[1] > 3
          then 'csv'
        when regexp_matches({sample}, '^\\s*[{{\\[]') then {kind} else 'unknown' end as format
      from heads"""
    words = "description|code|charge|price|procedure|service|billing|setting|gross|discounted"
    out["header_rows"] = f"""with d as (select doc_id, list_transform(
        list_slice(string_split(text, chr(10)), 1, 5), lambda r: string_split(r, ',')) as rows
        from ({duck(X.TABLE_TEXTS)})),
      hits as (select doc_id, i - 1 as i from d, lateral (select unnest(range(1, len(rows) + 1)) as i)
        where (trim(lower(rows[i][1])) = 'description'
            and len(list_filter(rows[i], lambda c: contains(lower(c), 'setting'))) > 0)
          or len(list_filter(rows[i], lambda c: regexp_matches(lower(c), '{words}')))
            / len(rows[i])::double > 0.3::double)
      select doc_id, cast(coalesce(min(i), 0) as integer) as header_row
      from d left join hits using (doc_id) group by doc_id"""
    out["file_headers"] = duck(X.FILE_HEADERS_EXPECTED)

    for kind_ in ("csv", "json", "array", "nested", "split_json", "split_array", "ndjson"):
        out[f"ingested_{kind_}"] = file_ops
    out["ingested_quoted_csv"] = file_ops.replace(
        "p_name as description",
        "concat(p_name, '\\n\"quoted\", ', p_name) as description".replace("\\n", "' || chr(10) || '"),
    )
    file_hospitals = f"""select facility_name, city, state,
        concat({{lead}}) as address, concat('bsw-n', cast(n_nationkey as varchar), '-med-ctr')
        as facility_id, '2.0.0' as file_version, '2025-01-01' as last_updated
      from ({duck(X.FILE_FACILITIES)}) where n_nationkey in (select s_nationkey from supplier)"""
    street = "cast(n_nationkey as varchar), ' Main St, ', city, ', ', state, ' 78701'"
    out["ingested_hospitals"] = file_hospitals.format(lead=street)
    out["explicit_hospitals"] = file_hospitals.format(lead="city, ', ', state")
    out["ingest_report"] = f"""{FILE_BEST}, {report}
      select concat('bsw-n', source_file, '-med-ctr') as facility_id, 'ok' as status,
        'csv' as format, read_records, accepted_records, failed_records, no_standard_code,
        missing_cash_price, not_outpatient, 0 as broken_records, successful_records, duplicate_records,
        total_records from report"""
    out["ingest_totals"] = f"{FILE_BEST}, {report} {totals}, 0 as file_errors from report"
    out["files_without_metadata"] = """select concat('bsw-n', cast(s_nationkey as varchar)) as nation,
        'missing_metadata' as status, 'city,state,address' as missing, 0 as read_records
      from supplier group by s_nationkey"""
    valid = """where gross_charge is not null and
      (negotiated_min is null or negotiated_max is null or negotiated_min <= negotiated_max)"""
    out["stored_operations"] = f"{file_ops} {valid}"
    out["stored_code_lookup"] = f"""{file_ops} {valid} and contains(codes_key, '"0476"')"""
    out["streamed_operations"] = f"{file_ops} {valid}"
    out["quarantined_operations"] = f"""{FILE_BEST} select facility_id, description, codes_key,
        'negotiated_range' as broken_rules from best where negotiated_min > negotiated_max"""
    out["exported_json"] = CHARGES_TO_BEST + ops
    out["exported_csv"] = CHARGES_TO_BEST + ops
    out["exported_ndjson"] = CHARGES_TO_BEST + ops
    out["upserted_hospitals"] = f"""with {HOSPITALS}
      select facility_id, case when state = 'TX' then concat(facility_name, ' II')
          else facility_name end as facility_name, state,
        timestamp '2025-01-01 00:00:00' as created_at,
        case when state = 'TX' then timestamp '2025-02-01 00:00:00'
          else timestamp '2025-01-01 00:00:00' end as updated_at
      from hospitals"""
    by_label = """select label as query_id, arg_min(embedding, vec_id) as query_vector
      from embeddings group by label"""
    out["similar_queries"] = similar(by_label, "query_id, id, rank")
    out["similar_to_one"] = similar(
        "select 0 as query_id, arg_min(embedding, vec_id) as query_vector from embeddings",
        "id, user_query, confidence_score",
    )
    out["degraded_search"] = f"""with cache as ({duck(X.QUERY_CACHE)})
      select id, user_query, confidence_score from cache where confidence_score >= 0.90
      order by id limit 5"""
    out["file_manifest"] = """select s_nationkey as nation, true as sized, true as dated, true as named
      from supplier group by s_nationkey"""
    out.update(rough())
    return out


# Files derived from parts: each part is one line, or three items, of its hospital's file.
_PARTS = """select p_partkey % 5 as r, concat('roug-r', cast(p_partkey % 5 as varchar), '-hosp') as facility_id,
    p_partkey, p_name, p_size from part"""


def _part_rows(description: str = "p_name", facility: str = "facility_id", where: str = "true", more: str = "") -> str:
    money = lambda e: f"cast({e} as decimal(12,2))"
    return f"""select {facility} as facility_id, {description} as description,
        concat('{{"HCPCS":["', cast(p_partkey as varchar), '"]}}') as codes_key, cast(null as varchar) as rc_code,
        cast(p_partkey as varchar) as hcpcs_code, {money('p_size')} as cash_price, {money('p_size + 1')} as gross_charge,
        {money('null')} as negotiated_min, {money('null')} as negotiated_max
      from ({_PARTS}){more} where {where}"""


def rough() -> dict[str, str]:
    inch = """case p_partkey % 4 when 0 then concat(p_name, ' 5" LONG') when 1 then concat('say "', p_name, '"')
        when 2 then concat(p_name, chr(10), 'second') else p_name end"""
    after = """ union all select distinct facility_id, 'after', '{"HCPCS":["2"]}', null, '2', cast(1 as decimal(12,2)),
        cast(2 as decimal(12,2)), null, null from (""" + _PARTS + ")"
    per_file = lambda read, failed: f"""select cast(p_partkey % 5 as integer) as r, 'malformed' as status,
        count(*) + {read} as read_records, {failed} as failed_records, 1 as broken_records from part group by 1"""
    return {
        "ingested_inch_marks": _part_rows(inch) + after,
        "ingest_report_inch_marks": per_file(2, 1),
        "ingested_mixed_json": _part_rows("concat(p_name, s)", more=" cross join (values (''), (' b'), (' c')) v(s)"),
        "ingested_truncated_json": _part_rows(),
        # the empty item at the start of each document has no code, the last one breaks off
        "ingest_report_json": per_file(2, 2),
        "ingested_long_line_ndjson": _part_rows(facility="concat('give-g', cast(r as varchar), '-clin')"),
        "overridden_hospitals": """select distinct concat('Given G', cast(p_partkey % 5 as varchar), ' Clinic') as facility_name,
            'Dallas' as city, 'TX' as state, '9 West St' as address,
            concat('give-g', cast(p_partkey % 5 as varchar), '-clin') as facility_id, '3.0.0' as file_version,
            '2025-03-03' as last_updated from part""",
        "colliding_files": """select cast(p_partkey % 5 as integer) as r,
            case p_partkey % 5 when 4 then 'ok' else 'id_collision' end as status,
            case p_partkey % 5 when 4 then count(*) else 0 end as rows from part group by p_partkey % 5""",
        "unreadable_files": """select cast(p_partkey % 5 as integer) as r,
            case p_partkey % 5 when 0 then 'unreadable' else 'ok' end as status,
            case p_partkey % 5 when 0 then 0 else count(*) end as read_records, p_partkey % 5 = 0 as failed
          from part group by p_partkey % 5""",
        "ingested_file": f"""select facility_id, p_name as description, cast(p_partkey as varchar) as hcpcs_code,
            '2025-01-01T00:00:00' as ingested_at from ({_PARTS}) where r = 1""",
        "ingested_with_duplicates": f"select facility_id, count(*) as rows from ({_PARTS}) group by facility_id",
        "stored_two_files": _part_rows(),
        "stored_correction": """select count(*) as rows, sum(cast(p_size as decimal(12,2))) as cash,
            count_if(p_partkey % 7 = 0) as were_aside, 0 as still_aside from part""",
        "stored_summary": f"""select facility_id, count(*) as total_operations, min(cast(p_size as decimal(10,2))) as min_cash_price,
            max(cast(p_size as decimal(10,2))) as max_cash_price, round(cast(sum(p_size) as double) / count(*), 4) as avg_cash_price
          from ({_PARTS}) where r > 0 group by facility_id""",
        "stored_purge": _part_rows(where="(p_partkey % 2 = 1 and r > 0) or (p_partkey % 2 = 0 and r > 1)"),
        "streamed_hospitals": f"""select distinct facility_id, concat('Rough R', cast(r as varchar), ' Hospital') as facility_name,
            'Austin' as city, 'TX' as state, '1 East St, Austin, TX 78613' as address, '2.0.0' as file_version,
            concat('2025-0', cast(r + 1 as varchar), '-01') as last_updated from ({_PARTS})""",
        "exported_hospitals": f"""with {HOSPITALS} select facility_id, facility_name, city, state, address, source_url,
            file_version, last_updated, kind from hospitals, (values ('json'), ('csv')) v(kind)""",
    }
