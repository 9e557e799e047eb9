"""Declared columns of the 15 source tables.

``prospect.prospect_id``, ``staff.id_number``, ``proposal.proposal_id`` and the codes of the lookup tables are keys of
their tables. Everything else may repeat; (prospect, primary flag) of the pool and the entity bridge included.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "prospect": "prospect_id bigint, active_ind string, stage_code string, start_date timestamp_ntz, "
    "stop_date timestamp_ntz",
    "assignment": "prospect_id bigint, assignment_id_number string, assignment_type string, active_ind string, "
    "priority_code string, start_date timestamp_ntz, date_added timestamp_ntz, stop_date timestamp_ntz, "
    "proposal_id bigint",
    "staff": "id_number string, sort string, staff_type_code string, active_ind string, unit_code string, "
    "office_code string, start_date timestamp_ntz, date_added timestamp_ntz",
    "contact_report": "report_id bigint, prospect_id bigint, id_number string, author_id_number string, "
    "contact_type string, contact_initiated_by string, contact_purpose_code string, contact_outcome string, "
    "contact_date timestamp_ntz",
    "proposal": "proposal_id bigint, prospect_id bigint, proposal_type string, active_ind string, "
    "proposal_status_code string, stage_code string, start_date timestamp_ntz, stop_date timestamp_ntz, "
    "date_added timestamp_ntz, proposal_title string, original_ask_amt decimal(18,2), ask_amt decimal(18,2), "
    "anticipated_amt decimal(18,2), granted_amt decimal(18,2), initial_contribution_date timestamp_ntz, "
    "expected_date timestamp_ntz, plan_gift_ind string, unit_code string",
    "stage": "prospect_id bigint, proposal_id bigint, stage_code string, stage_date timestamp_ntz, "
    "date_added timestamp_ntz",
    "prospect_entity": "prospect_id bigint, id_number string, primary_ind string",
    "ucdr_prospect_pool": "prosp_id bigint, id_number string, prim_prosp_ind string, pers_org_ind string, "
    "sort_name string, pref_mail_name string, age int, spouse_age int, record_type_code string, "
    "spouse_record_type_code string, home_business_state string, home_business_county string, "
    "high_act_ask_plan decimal(18,2), highest_active_ask decimal(18,2), abs_high_capacity_ucdt_asks decimal(18,2), "
    "abs_high_capacity_ucdt_ask_lvl string, high_ucdt_or_capacity decimal(18,2), "
    "lifetime_giving_devel decimal(18,2), first_fy_gift int, first_fy_major_gift int, last_fy_gift int, "
    "last_fy_major_gift int, nbr_giving_yrs int, nbr_of_gifts int, gift_in_each_of_last_3_fy string, "
    "last_contact_date timestamp_ntz, last_contact_author string, last_contact_attempt timestamp_ntz, "
    "last_contact_attempt_auth string, date_last_face_2_face timestamp_ntz, last_face2face_author string, "
    "date_last_mg_ask timestamp_ntz, last_mg_ask_author string",
    "ucdr_giving": "id_number string, date_of_record timestamp_ntz, prim_amt decimal(18,2), giving_ind string, "
    "prog_hier_num string",
    "ucdr_bio": "id_number string, sort_name string",
    "tms_stage": "stage_code string, short_desc string, full_desc string",
    "tms_unit_code": "unit_code string, short_desc string, full_desc string",
    "tms_office": "office_code string, short_desc string",
    "tms_proposal_status": "proposal_status_code string, short_desc string",
    "tms_proposal_stage": "stage_code string, short_desc string",
}

TABLE_NAMES = tuple(_DDL)


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])
