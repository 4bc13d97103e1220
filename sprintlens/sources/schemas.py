"""Schemas of the domain tables; nothing is inferred."""

MINED_COMMITS = "repo_path string, commit_id string, parent_id string, author_id string, authored_at timestamp, changed_files array<string>"
PULL_REQUESTS = (
    "pr_id string, repo string, author_id string, opened_at string, merged_at string, commits array<string>,"
    " review_rounds int, review_comments int, ci_runs int, ci_failures int, metadata map<string,string>"
)
SPRINT_INPUTS = (
    "sprint struct<sprint_id:string,start_date:date,length_days:int,working_days:array<int>>,"
    " capacity array<struct<person_id:string,day:date,delta_available_sch:double>>,"
    " work_items array<struct<work_item_id:string,status:string,scope_factor:double,story_points:double,effort:struct<type:string,quantiles:map<string,double>,weights:array<double>,means:array<double>,stds:array<double>,low:double,high:double>,model_version:string>>"
)
SPRINT_HISTORY = "sprint_id string, done_effort_hours double, workdays double"
THROUGHPUT = "throughput_samples_sch_per_day array<double>"
CHECK_RUNS = "repo string, pr_number int, run_id bigint, name string, conclusion string, started_at string, completed_at string"
