from pyspark.sql import functions as F

from cloakwork.functions.text import salted_uid
from cloakwork.operators import elements as el
from cloakwork.operators.preview import before_after_elements
from cloakwork.rules import Policy
from cloakwork.schemas import ELEMENTS

ROWS = [
    (0x0010, 0x0010, "PatientName", "PN", "Jia^Test"), (0x0010, 0x0020, "PatientID", "LO", "Q10001"), (0x0010, 0x0030, "PatientBirthDate", "DA", "19500101"),
    (0x0010, 0x0040, "PatientSex", "CS", "M"), (0x0008, 0x0080, "InstitutionName", "LO", "Example Hospital"), (0x0008, 0x1010, "StationName", "SH", "STATION1"),
    (0x0008, 0x0090, "ReferringPhysicianName", "PN", "Dr^Example"), (0x0008, 0x009C, "ConsultingPhysicianName", "PN", "Dr^Other"), (0x0008, 0x0050, "AccessionNumber", "SH", "ACC000001"),
    (0x0008, 0x0020, "StudyDate", "DA", "20190101"), (0x0008, 0x0030, "StudyTime", "TM", "1200"), (0x0008, 0x0016, "SOPClassUID", "UI", "1.2.840.10008.5.1.4.1.1.2"), (0x0008, 0x0018, "SOPInstanceUID", "UI", "1.2.999.1.3"),
    (0x0018, 0x1030, "ProtocolName", "LO", "Brain of Jia"), (0x0041, 0x1001, None, "LO", "private note"), (0x6000, 0x0010, None, "US", "4"), (0x5001, 0x0010, None, "US", "4"),
]
TOKENS = [("p", "Patient_0001", ["ACC000001", "Jia"])]


def frame(spark, rows, file_id="f"):
    full = [(file_id, "p", r[5] if len(r) > 5 else "dataset", r[6] if len(r) > 6 else [], *r[:4], r[4] if isinstance(r[4], list) else [r[4]]) for r in rows]
    return spark.createDataFrame(full, ELEMENTS)


def tokens(spark):
    return spark.createDataFrame(TOKENS, "patient_key string, pseudo_id string, tokens array<string>")


def after(spark, rows=ROWS, **options):
    return {x.keyword: "\\".join(x.values_after) for x in el.deid_elements(frame(spark, rows), tokens(spark), **options).collect()}


def test_rules(spark):
    got = after(spark)
    assert got["PatientName"] == got["PatientID"] == "Patient_0001"
    assert got["PatientBirthDate"] == got["InstitutionName"] == got["ReferringPhysicianName"] == got["ConsultingPhysicianName"] == got["AccessionNumber"] == ""
    assert (got["PatientSex"], got["StationName"], got["StudyDate"], got["ProtocolName"]) == ("M", "STATION1", "20190101", "Brain of Patient_0001")
    assert got["SOPClassUID"].startswith("1.2.840.10008") and got["SOPInstanceUID"].startswith("2.25.1") and len(got["SOPInstanceUID"]) == 44
    assert None not in got


def test_dates_and_private(spark):
    got = after(spark, keep_dates=False, remove_private=False)
    assert got["StudyDate"] == "" and got["StudyTime"] == "1200" and got[None] == "private note"


def test_policy(spark):
    policy = Policy.of(extra_remove_dicom=["protocolname", "PatientSex"], keep_dicom=["AccessionNumber", "PatientName"], keep=["consultingphysicianname"], keep_xml=["InstitutionName"])
    got = after(spark, policy=policy)
    assert got["ProtocolName"] == got["PatientSex"] == got["InstitutionName"] == ""
    assert got["AccessionNumber"] == "Patient_0001"  # kept by the policy, but a known token
    assert got["PatientName"] == "Patient_0001" and got["ConsultingPhysicianName"] == "Dr^Other"


def test_sequences_and_counts(spark):
    inside = [(0x0010, 0x1002, "OtherPatientIDsSequence", "SQ")]
    kept = [(0x0040, 0x0275, "RequestAttributesSequence", "SQ")]
    private = [(0x0041, 0x1010, None, "SQ")]
    rows = [
        (0x0010, 0x1002, "OtherPatientIDsSequence", "SQ", []), (0x0010, 0x0020, "PatientID", "LO", "X1", "dataset", inside), (0x0040, 0x0275, "RequestAttributesSequence", "SQ", []),
        (0x0041, 0x1001, None, "LO", "n", "dataset", kept), (0x0040, 0x1001, "RequestedProcedureID", "SH", "R", "dataset", kept), (0x0041, 0x1010, None, "SQ", []),
        (0x0043, 0x1010, None, "UI", "1.2.9", "dataset", private), (0x0002, 0x0003, "MediaStorageSOPInstanceUID", "UI", "1.2.999.1.3", "meta"), (0x0008, 0x010D, None, "UI", ["1.2.999.0.1", "1.2.840.10008.1", "1.2.840.100080000.1", ""]),
    ]
    df = frame(spark, rows)
    actions = {(x.group, x.element, len(x.ancestors)): x.action for x in el.element_action(df).collect()}
    assert actions == {(16, 0x1002, 0): "drop_sequence", (16, 32, 1): "drop_nested", (0x40, 0x275, 0): "keep", (0x41, 0x1001, 1): "drop_private", (0x40, 0x1001, 1): "blank", (0x41, 0x1010, 0): "drop_private", (0x43, 0x1010, 1): "drop_nested", (2, 3, 0): "remap", (8, 0x10D, 0): "remap"}
    assert el.uid_remap_count(df).first().uids_remapped == 4 and el.private_removed_count(df).first().private_removed == 2
    got = after(spark, rows)
    uids = el.deid_elements(df, tokens(spark)).where("element = 269").first().values_after
    assert uids[1] == "1.2.840.10008.1" and uids[3] == "" and len({uids[0], uids[2]}) == 2 and uids[0].startswith("2.25.1")
    assert got["MediaStorageSOPInstanceUID"] == after(spark)["SOPInstanceUID"]


def test_uid_salt(spark):
    one, two = (spark.range(1).select(salted_uid(s)(F.lit("1.2.9")).alias("x")).first().x for s in ("a", "b"))
    assert one != two and one == spark.range(1).select(salted_uid("a")(F.lit("1.2.9")).alias("x")).first().x


def test_burned_in(spark):
    def reason(*rows):
        found = el.burned_in_flags(frame(spark, rows)).collect()
        return found[0].reason if found else None

    burned, modality = (0x28, 0x301, "BurnedInAnnotation", "CS"), (8, 0x60, "Modality", "CS")
    sop = (8, 0x16, "SOPClassUID", "UI")
    assert reason((*burned, "yes"), (*modality, "SC")) == "BurnedInAnnotation=YES"
    assert reason((*burned, "NO"), (*modality, "ot")) == "Modality=OT"
    assert reason((*modality, "CT"), (*sop, "1.2.840.10008.5.1.4.1.1.77.1")) == "Secondary Capture"
    assert reason((*sop, "1.2.840.10008.5.1.4.1.1.104.1")) == reason((0x42, 0x11, "EncapsulatedDocument", "OB", "")) == "EncapsulatedDocument"
    assert reason((*modality, "CT"), (*sop, "1.2.840.10008.5.1.4.1.1.2")) is None


def test_before_after(spark):
    df = frame(spark, ROWS)
    rows = {x.keyword: x for x in before_after_elements(df, el.deid_elements(df, tokens(spark))).collect()}
    assert rows["PatientName"].changed and not rows["PatientSex"].changed and "ProtocolName" not in rows
