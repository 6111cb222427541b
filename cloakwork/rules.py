"""Rule lists and the user's policy. The lists are fixed values: results depend on every entry."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header keywords that are emptied.
BLANK_KEYWORDS = [
    "PatientBirthDate", "PatientBirthTime", "PatientBirthName", "PatientMotherBirthName", "PatientAddress", "PatientTelephoneNumbers",
    "PatientTelecomInformation", "OtherPatientIDs", "OtherPatientNames", "OtherPatientIDsSequence", "IssuerOfPatientID", "MilitaryRank",
    "BranchOfService", "MedicalRecordLocator", "CountryOfResidence", "RegionOfResidence", "PatientReligiousPreference", "PatientComments", "EthnicGroup",
    "Occupation", "AdditionalPatientHistory", "InstitutionName", "InstitutionAddress", "InstitutionalDepartmentName", "InstitutionCodeSequence",
    "ReferringPhysicianName", "ReferringPhysicianAddress", "ReferringPhysicianTelephoneNumbers", "PhysiciansOfRecord", "PerformingPhysicianName",
    "NameOfPhysiciansReadingStudy", "OperatorsName", "RequestingPhysician", "RequestingService", "ScheduledPerformingPhysicianName", "StudyID",
    "AccessionNumber", "AdmissionID", "IssuerOfAdmissionID", "ServiceEpisodeID", "PerformedProcedureStepID", "RequestedProcedureID",
    "ScheduledProcedureStepID", "CurrentPatientLocation", "PatientTransportArrangements", "PatientInsurancePlanCodeSequence",
    "InsurancePlanIdentification", "OrderCallbackPhoneNumber", "OrderEnteredBy", "OrderEntererLocation", "NamesOfIntendedRecipientsOfResults",
    "HumanPerformersName", "HumanPerformersOrganization", "VerifyingObserverName", "ContentCreatorName",
]

# Header keywords known to be harmless.
KEEP_KEYWORDS = [
    "StationName", "DeviceSerialNumber", "Manufacturer", "ManufacturerModelName", "SoftwareVersions", "ProtocolName", "SeriesDescription",
    "StudyDescription", "BodyPartExamined", "PatientSex", "PatientAge", "PatientWeight", "PatientSize", "Modality",
]

# Report tags whose content becomes the pseudonym.
PSEUDO_TAGS = ["PatientName", "PatientNameC", "PatientFN", "PatientFNC", "PatientSN", "PatientSNC", "PatientID"]

# Report tags that are emptied, in this order.
BLANK_TAGS = [
    "PatientUID", "PatientBirthday", "OutPatientNo", "InPatientNo", "CaseNO", "Patient_tel", "patient_cellphone", "Patient_Address", "patient_idcard",
    "AccessionNumber", "StudyInstanceUID", "StudyID", "ReportingPhysician", "ReferringPhysician", "PreReferringPhysician", "ReportPhysician",
    "shenqingYiShi", "Operator", "OperatorCode", "CREATED_BY", "ReportDoctor", "ExamDoctor", "AuditDoctor", "VerifyDoctor", "ApplyDoctor",
    "RequestDoctor", "OperatorName", "TechnicianName", "HospitalName", "Hospital", "Department", "Ward", "BedNo", "BedNumber", "department", "bingqu",
    "chuanghao", "laiyuan", "InsuranceType", "FactPrice", "VIP",
]

# Report tags whose content is collected as names, as ids, and as free text that counts as names.
NAME_TAGS = ["PatientName", "PatientNameC", "PatientFN", "PatientFNC", "PatientSN", "PatientSNC"]
ID_TAGS = [
    "PatientID", "OutPatientNo", "InPatientNo", "CaseNO", "StudyInstanceUID", "patient_idcard", "Patient_tel", "patient_cellphone", "AccessionNumber",
    "PatientUID",
]
TEXT_TAGS = [
    "Patient_Address", "ReportingPhysician", "ReferringPhysician", "PreReferringPhysician", "ReportPhysician", "shenqingYiShi", "Operator", "CREATED_BY",
    "ReportDoctor", "ExamDoctor", "AuditDoctor", "HospitalName",
]

# Report tags known to be harmless.
KEEP_TAGS = [
    "PatientSex", "PatientAge", "Patient_Stature", "PATIENT_WEIGHT", "StudyDate", "SeriesDate", "SeriesTime", "StudyTime", "WriteDateTime",
    "ReferringDate", "Modality", "SeriesDescription", "StudyDescription", "BodyPartExamined", "StationName", "nudi", "linchuangzhenduan", "Lishibingshi",
    "Report", "StudyClass0", "StudyClass1", "StudyClass2", "SeriesNumber", "StudyNo", "ImageNumber", "Image_x0020_Count", "studytimes", "INFOTYPE",
    "ReportStatus", "Pathology", "fusion", "StudyComponentType", "WorkFlow",
]

# Header keywords shown before and after.
DISPLAY_KEYWORDS = [
    "PatientName", "PatientID", "PatientBirthDate", "PatientSex", "PatientAge", "PatientWeight", "PatientSize", "InstitutionName", "InstitutionAddress",
    "StationName", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName", "AccessionNumber", "StudyID", "StudyDate", "SeriesDate",
    "Modality", "StudyDescription", "SeriesDescription", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID",
]

# Kinds of value representations, roots and prefixes of identifiers.
TEXT_VRS = ["LO", "SH", "ST", "LT", "UT", "UC", "PN"]
SCRUB_VRS = ["LO", "SH", "ST", "LT", "UT", "UC", "CS"]
BINARY_VRS = ["OB", "OW", "OF", "OD", "UN", "SQ"]
STANDARD_ROOT = "1.2.840.10008"
CAPTURE_PREFIX = "1.2.840.10008.5.1.4.1.1.7"
ENCAPSULATED_PREFIX = "1.2.840.10008.5.1.4.1.1.104"
REMOVE, KEEP, PSEUDO, REMAP, UNKNOWN = "去除", "保留", "假名", "重映射", "未知"
LEAST_TOKEN = 2
LEAST_NUMBER = 4


@dataclass(frozen=True)
class Policy:
    """What the user adds to and takes from the rules; names compare without case."""

    extra_remove_dicom: frozenset[str] = frozenset()
    extra_remove_xml: frozenset[str] = frozenset()
    keep: frozenset[str] = frozenset()
    keep_dicom: frozenset[str] = frozenset()
    keep_xml: frozenset[str] = frozenset()
    keep_dates: bool = True

    @classmethod
    def of(cls, **sets: Iterable[str] | bool) -> Policy:
        return cls(**{k: v if isinstance(v, bool) else frozenset(v) for k, v in sets.items()})

    @staticmethod
    def _among(name: Column, names: frozenset[str]) -> Column:
        return F.coalesce(F.lower(name).isin(sorted(n.lower() for n in names)), F.lit(False)) if names else F.lit(False)

    def removes(self, source: str, name: Column) -> Column:
        return self._among(name, self.extra_remove_dicom if source == "DICOM" else self.extra_remove_xml)

    def keeps(self, source: str, name: Column) -> Column:
        return self._among(name, self.keep | (self.keep_dicom if source == "DICOM" else self.keep_xml))

    def keeps_tag(self, tag: str) -> bool:
        return tag.lower() in {n.lower() for n in self.keep | self.keep_xml}

    def all_keep(self) -> frozenset[str]:
        return self.keep | self.keep_dicom | self.keep_xml

    def table(self, spark: SparkSession) -> DataFrame:
        """policy_rules (source, name_lc, action); a global keep is listed for both sources."""
        rows = [("DICOM", n, "remove") for n in self.extra_remove_dicom] + [("XML", n, "remove") for n in self.extra_remove_xml]
        rows += [(s, n, "keep") for s, names in (("DICOM", self.keep | self.keep_dicom), ("XML", self.keep | self.keep_xml)) for n in names]
        return spark.createDataFrame([(s, n.lower(), a) for s, n, a in sorted(rows)], "source string, name_lc string, action string")
