"""Two sites with opposite policies in one run against two separate runs."""

from functools import reduce

from pyspark.sql import functions as F

from cloakwork.operators.elements import deid_elements
from cloakwork.operators.policies import deid_elements_by_rules, deid_reports_by_rules
from cloakwork.operators.reports import deid_reports
from cloakwork.rules import Policy
from cloakwork.schemas import ELEMENTS

SITES = {
    "a": Policy.of(extra_remove_dicom=["ProtocolName"], keep_dicom=["InstitutionName"], keep=["ConsultingPhysicianName"], extra_remove_xml=["Report", "a-b"], keep_xml=["PatientBirthday", "PatientID"]),
    "b": Policy.of(keep_dicom=["ProtocolName", "OtherPatientIDsSequence"], extra_remove_xml=["StudyDate"], keep=["Ward"]),
    "c": Policy(),
}


def test_opposite_policies_in_one_run(spark):
    patients = {f"{site}{i}": policy for site, policy in SITES.items() for i in range(3)}
    inside = [(0x0010, 0x1002, "OtherPatientIDsSequence", "SQ")]
    fields = [(0x0018, 0x1030, [], "ProtocolName", "LO", "Brain of Roe"), (0x0008, 0x0080, [], "InstitutionName", "LO", "Clinic"), (0x0008, 0x009C, [], "ConsultingPhysicianName", "PN", "Dr"), (0x0010, 0x1002, [], "OtherPatientIDsSequence", "SQ", ""), (0x0010, 0x0021, inside, "IssuerOfPatientID", "LO", "x"), (0x0041, 0x1001, [], None, "LO", "n")]
    elements = spark.createDataFrame([(f"f{p}", p, "dataset", up, g, e, k, vr, [v]) for p in patients for g, e, up, k, vr, v in fields], ELEMENTS)
    text = "<PatientID>7</PatientID><patientbirthday>1950</patientbirthday><Ward>w</Ward><StudyDate>2019</StudyDate><a-b>x</a-b><Report>Roe $1</Report>"
    reports = spark.createDataFrame([(f"r{p}", p, text) for p in patients], "file_id string, patient_key string, text string")
    tokens = spark.createDataFrame([(p, f"Patient_{i:04d}", ["Roe"]) for i, p in enumerate(patients)], "patient_key string, pseudo_id string, tokens array<string>")
    rules = reduce(lambda x, y: x.union(y), [policy.table(spark).select(F.lit(p).alias("patient_key"), "source", "name_lc", "action") for p, policy in patients.items() if p[0] != "c"])
    got = deid_elements_by_rules(elements, tokens, rules.union(rules.limit(2)), uid_fn=F.upper)
    want = [deid_elements(elements.where(F.col("patient_key").startswith(site)), tokens, policy, uid_fn=F.upper) for site, policy in SITES.items()]
    assert sorted(got.collect(), key=str) == sorted((x for df in want for x in df.select(*got.columns).collect()), key=str)
    got = deid_reports_by_rules(reports, tokens, rules)
    want = [deid_reports(reports.where(F.col("patient_key").startswith(site)), tokens, policy) for site, policy in SITES.items()]
    assert sorted(got.collect(), key=str) == sorted((x for df in want for x in df.select(*got.columns).collect()), key=str)
    assert len({x.text_after for x in got.collect()}) >= 7
