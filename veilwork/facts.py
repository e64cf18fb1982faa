"""What is known of each kind of personal data: 53 rows, small enough to broadcast.

``LOCATION`` and ``DATE_TIME`` are aliases: detection reports them as ``ADDRESS`` and ``DATE``, so 51 kinds are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Kind, information type, risk level (1 to 3), whether HIPAA protects it (PHI or NON_PHI)
FACTS = (
    ("DATE", "Birth Date", 2, "PHI"),
    ("NRP", "Nationality, Religion, Political Affiliation", 2, "NON_PHI"),
    ("EMAIL_ADDRESS", "Email Address", 3, "PHI"),
    ("IP_ADDRESS", "IP Address", 3, "PHI"),
    ("PHONE_NUMBER", "Home Phone Number, Cell Phone Number", 3, "PHI"),
    ("ADDRESS", "Address", 2, "NON_PHI"),
    ("US_DRIVERS_LICENSE_NUMBER", "Driver's License Number", 3, "PHI"),
    ("CREDIT_CARD_NUMBER", "Credit Card Number", 3, "PHI"),
    ("ABA_ROUTING_NUMBER", "American Bankers Association Routing Number (Financial Accounts)", 3, "PHI"),
    ("INTERNATIONAL_BANKING_ACCOUNT_NUMBER", "International Banking Account Number (Financial Accounts)", 3, "PHI"),
    ("US_BANK_ACCOUNT_NUMBER", "United States Bank Account Number (Financial Accounts)", 3, "PHI"),
    ("US_SOCIAL_SECURITY_NUMBER", "Social Security Number", 3, "PHI"),
    ("LOCATION", "Location", 2, "PHI"),
    ("US_PASSPORT_NUMBER", "Passport Number", 3, "PHI"),
    ("AGE", "Age", 2, "NON_PHI"),
    ("PERSON", "Person", 3, "PHI"),
    ("CRYPTO", "Crypto (Financial Accounts)", 2, "NON_PHI"),
    ("URL", "URL", 2, "NON_PHI"),
    ("DATE_TIME", "Date", 2, "PHI"),
    ("MEDICAL_LICENSE", "Medical License", 3, "NON_PHI"),
    ("US_INDIVIDUAL_TAXPAYER_IDENTIFICATION", "United States Individual Taxpayer Identification", 3, "PHI"),
    ("AU_BUSINESS_NUMBER", "Australian Business Number", 3, "PHI"),
    ("AU_COMPANY_NUMBER", "Australian Company Number", 3, "PHI"),
    ("AU_MEDICAL_ACCOUNT_NUMBER", "Australian Medicare Number", 3, "PHI"),
    ("AU_TAX_FILE_NUMBER", "Australian Tax File Number", 3, "PHI"),
    ("MAC_ADDRESS", "MAC Address", 2, "NON_PHI"),
    ("US_MBI", "US Medicare Beneficiary Identifier", 3, "PHI"),
    ("UK_NHS", "UK National Health Service Number", 3, "PHI"),
    ("UK_NINO", "UK National Insurance Number", 3, "PHI"),
    ("ES_NIF", "Spain NIF (Tax ID)", 3, "PHI"),
    ("ES_NIE", "Spain NIE (Foreigner ID)", 3, "PHI"),
    ("IT_FISCAL_CODE", "Italy Fiscal Code (Codice Fiscale)", 3, "PHI"),
    ("IT_DRIVER_LICENSE", "Italy Driver License", 3, "PHI"),
    ("IT_VAT_CODE", "Italy VAT Code", 2, "NON_PHI"),
    ("IT_PASSPORT", "Italy Passport Number", 3, "PHI"),
    ("IT_IDENTITY_CARD", "Italy Identity Card", 3, "PHI"),
    ("PL_PESEL", "Poland PESEL (National ID)", 3, "PHI"),
    ("SG_NRIC_FIN", "Singapore NRIC/FIN", 3, "PHI"),
    ("SG_UEN", "Singapore UEN (Business ID)", 2, "NON_PHI"),
    ("IN_PAN", "India PAN (Permanent Account Number)", 3, "PHI"),
    ("IN_AADHAAR", "India Aadhaar", 3, "PHI"),
    ("IN_VEHICLE_REGISTRATION", "India Vehicle Registration", 2, "NON_PHI"),
    ("IN_VOTER", "India Voter ID", 3, "PHI"),
    ("IN_PASSPORT", "India Passport Number", 3, "PHI"),
    ("IN_GSTIN", "India GST Identification Number", 2, "NON_PHI"),
    ("FI_PERSONAL_IDENTITY_CODE", "Finland Personal Identity Code", 3, "PHI"),
    ("KR_DRIVER_LICENSE", "Korea Driver License", 3, "PHI"),
    ("KR_FRN", "Korea Foreign Registration Number", 3, "PHI"),
    ("KR_PASSPORT", "Korea Passport Number", 3, "PHI"),
    ("KR_BRN", "Korea Business Registration Number", 2, "NON_PHI"),
    ("KR_RRN", "Korea Resident Registration Number", 3, "PHI"),
    ("TH_TNIN", "Thailand National ID Number", 3, "PHI"),
    ("MISC", "MISC Text", 1, "NON_PHI"),
)
HIPAA = {"PHI": "Protected Health Information", "NON_PHI": "Not Protected Health Information"}
ALIASES = {"DATE_TIME": "DATE", "LOCATION": "ADDRESS"}


def facts(spark: SparkSession) -> DataFrame:
    rows = [(k, t, r, HIPAA[h]) for k, t, r, h in FACTS]
    return spark.createDataFrame(rows, "kind string, information_type string, risk_level int, hipaa_category string")


def with_facts(findings: DataFrame) -> DataFrame:
    """findings (with kind) and their facts; a kind without facts is an error, raised by the task that meets it."""
    known = F.broadcast(facts(findings.sparkSession))
    joined = findings.withColumn("kind", F.coalesce(*[F.when(F.col("kind") == a, b) for a, b in ALIASES.items()], "kind")).join(known, "kind", "left")
    return joined.withColumn("information_type", F.coalesce("information_type", F.raise_error(F.concat(F.lit("no facts for "), "kind"))))


def sql_values() -> str:
    return ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}', {r}, '{HIPAA[h]}')" for k, t, r, h in FACTS)
