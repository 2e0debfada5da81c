"""Fixed variable lists, bin edges and category spellings."""

from __future__ import annotations

# The measured variables of the source tables.
CATEGORICAL = [
    "Capillary refill rate",
    "Glascow coma scale eye opening",
    "Glascow coma scale motor response",
    "Glascow coma scale total",
    "Glascow coma scale verbal response",
]

# Fixed values.
CONTINUOUS = [
    "Alanine aminotransferase", "Albumin", "Alkaline phosphate", "Anion gap",
    "Asparate aminotransferase", "Basophils", "Bicarbonate", "Bilirubin",
    "Blood urea nitrogen", "Calcium", "Chloride", "Creatinine",
    "Diastolic blood pressure", "Fraction inspired oxygen", "Glucose",
    "Heart Rate", "Hematocrit", "Hemoglobin", "Lactate", "Lymphocytes",
    "Mean blood pressure", "Mean corpuscular volume", "Monocytes",
    "Neutrophils", "Oxygen saturation", "Partial pressure of carbon dioxide",
    "Phosphate", "Platelets", "Potassium", "Prothrombin time",
    "Red blood cell count", "Respiratory rate", "Systolic blood pressure",
    "Temperature", "White blood cell count", "pH",
]

# Bin edges that are not learned.
AGE_EDGES = [18, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90]
DAYS_EDGES = [0, 11, 16, 21, 25, 30.1, 35.1, 43, 48, 54, 60, 66, 72, 81, 90, 100.1]
HOURS_EDGES = [
    0, 0.5, 1.5, 2.5, 3.5, 6.5, 10.5, 16.5, 26.5,
    48.0, 48.1, 60.1, 80.1, 110.1, 150.1, 200.1,
]
FIXED_EDGES = {"Age": AGE_EDGES, "Days": DAYS_EDGES, "Hours": HOURS_EDGES}

# Spellings that mean the same level, and the level names.
SYNONYMS = {
    "Glascow coma scale eye opening": {
        "1 No Response": 0, "3 To speech": 1, "4 Spontaneously": 2,
        "2 To pain": 3, "To Speech": 1, "Spontaneously": 2, "To Pain": 3,
    },
    "Glascow coma scale motor response": {
        "5 Localizes Pain": 0, "6 Obeys Commands": 1, "4 Flex-withdraws": 2,
        "1 No Response": 3, "2 Abnorm extensn": 4, "3 Abnorm flexion": 5,
        "Abnormal extension": 4, "Obeys Commands": 1, "Localizes Pain": 0,
        "No response": 3, "Flex-withdraws": 2, "Abnormal Flexion": 5,
    },
    "Glascow coma scale verbal response": {
        "1.0 ET/Trach": 0, "5 Oriented": 1, "4 Confused": 2,
        "1 No Response": 3, "2 Incomp sounds": 4, "3 Inapprop words": 5,
        "No Response-ETT": 0, "Oriented": 1, "Inappropriate Words": 5,
        "Confused": 2, "Incomprehensible sounds": 4, "No Response": 3,
    },
}

# Control tokens in id order.
SPECIAL_TOKENS = [
    "<s>", "</covar>", "</label>", "</code>", "</ts>", "</adm>", "</s>",
    "<pad>", "<history>", "<forecast>", "</forecast>",
]

SPLITS = ("train", "val", "test", "synthetic")
HORIZON_HOURS = (12, 24, 36, 48)
PHENOTYPES = 25
