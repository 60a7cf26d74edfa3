"""Table operators on Apache Spark: DataFrame in, DataFrame out."""

from .functions import conditions, dates, text
from .functions.conditions import (
    assign_column,
    concat_text,
    double_to_int,
    if_else_columns,
    math_column,
    math_if,
    number_to_string,
    power,
    round_columns,
    rule_column,
    string_to_number,
    system_columns,
)
from .functions.dates import (
    current_timestamp_column,
    date_diff,
    extract_date_fields,
    format_datetime,
    set_time_of_day,
    shift_date,
    to_date_text,
    to_timestamp,
)
from .functions.rules import read_rules, rule_text_column
from .functions.text import replace_text, split_cell
from .operators import corpus, runs
from .operators.aggregates import aggregate_columns, group_by, list_pieces
from .operators.columns import constant_column, keep_columns, rename_columns, reorder_columns
from .operators.filters import (
    filter_ci,
    filter_equals,
    filter_has_value,
    filter_missing,
    filter_range,
    rule_filter,
    split_rows,
)
from .operators.joins import join_by_flags, join_tables
from .operators.params import (
    param_sweep,
    params_to_table,
    query_by_keys,
    row_to_params,
    table_or_else,
    with_params,
)
from .operators.python_code import for_each_group, python_table, python_two_tables, row_function
from .operators.sketches import (
    append_sketches,
    distinct_bound,
    distinct_sketches,
    estimate_distinct,
    merge_sketches,
    read_sketches,
)
from .operators.rows import (
    add_empty_rows,
    concat_tables,
    counter,
    date_range,
    drop_duplicate_rows,
    fill_missing,
    first_row,
    sort_rows,
    top_n,
)
from .operators.sweeps import threshold_sweep
from .session import configure, intermediate_tables, materialize, shared_dir
from .sources.batches import append_batch, read_batches, remove_unpublished
from .sources.files import (
    file_table,
    pack_files,
    parse_run_results,
    read_log_lines,
    read_packed,
    read_run_results,
    report_lines,
    scan_docs,
    write_documents,
    write_report,
)
from .sources.sql import NamedQueries, named_queries, read_sql
from .sources.tables import jdbc_options, read_jdbc, read_table, write_table
