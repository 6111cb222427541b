"""The tables' schemas."""

FILES = "file_id string, patient_key string, rel_path string, parent string, name string, stem string, ext string, kind string, length long"
ELEMENTS = (
    "file_id string, patient_key string, scope string, "
    "ancestors array<struct<group:int,element:int,keyword:string,vr:string>>, "
    "group int, element int, keyword string, vr string, values array<string>"
)
REPORTS = "file_id string, patient_key string, rel_path string, stem string, idx int, encoding string, text string"
CROSSWALK = "pseudo_id string, patient_key string, real_names array<string>, real_ids array<string>"
TOKENS = "patient_key string, pseudo_id string, token string, token_kind string"
POLICY_RULES = "source string, name_lc string, action string"
POLICY_JSON = "extra_remove_dicom array<string>, extra_remove_xml array<string>, keep array<string>, keep_dicom array<string>, keep_xml array<string>, keep_dates boolean"
LEAKS = "file_id string, kind string, token string, detail string"
