"""Lists and mappings of the shipped analysis.

Everything here is a parameter of the operators.  The labels, patterns, acronyms and grids
are fixed values: they must equal those of the election data and of the analysis rebuilt.
"""
from pyspark.sql import types as T

# Columns of the extracts and their types.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("ANO_ELEICAO", T.IntegerType()),
        T.StructField("SG_UF", T.StringType()),
        T.StructField("DS_CARGO", T.StringType()),
        T.StructField("DT_NASCIMENTO", T.StringType()),
        T.StructField("NR_CANDIDATO", T.IntegerType()),
        T.StructField("NM_CANDIDATO", T.StringType()),
        T.StructField("NM_URNA_CANDIDATO", T.StringType()),
        T.StructField("NR_PARTIDO", T.IntegerType()),
        T.StructField("SG_PARTIDO", T.StringType()),
        T.StructField("NM_PARTIDO", T.StringType()),
        T.StructField("DS_GENERO", T.StringType()),
        T.StructField("DS_GRAU_INSTRUCAO", T.StringType()),
        T.StructField("DS_ESTADO_CIVIL", T.StringType()),
        T.StructField("DS_COR_RACA", T.StringType()),
        T.StructField("DS_OCUPACAO", T.StringType()),
        T.StructField("DS_SIT_TOT_TURNO", T.StringType()),
    ]
)

# Offices and periods.
STATE = "DEPUTADO ESTADUAL"
FEDERAL = "DEPUTADO FEDERAL"
OFFICES = [STATE, FEDERAL]
PERIOD = "ANO_ELEICAO"
TRAIN_YEARS = [2014, 2018]
TEST_YEARS = [2022]
TARGET = "DS_SIT_TOT_TURNO"
FLAGS = ["RELIGIOSOS", "SEGURANCA"]

# Regular expressions for names on the ballot, religious theme.
RELIGIOUS_NAMES = [
    r"^APÓSTOLO", r"^APOSTOLO", r"^APÓSTOLA", r"^APOSTOLA", r"^BISPO", r"^BISPA",
    r"^CAPELÃO", r"^CAPELAO", r"^DOM\s", r"^IRMÃ", r"^IRMÃO", r"^IRMAO",
    r"MISSIONÁRIO", r"MISSIONARIO", r"MISSIONÁRIA", r"MISSIONARIA",
    r"o PASTOR", r"P\.B\.", r"PADRE", r"PASTOR\s", r"PASTORA\s", r"PASTOR$",
    r"PR\.", r"^PR\s", r"^PRA\s", r"^PRA\.", r"^REV\s", r"^REV\.",
    r"^REVERENDO", r"PRESBÍTERO", r"^PRESB\.", r"^PAI", r"^MÃE",
    r"^MINISTRO", r"^MINISTRA", r"^ABENÇOADO", r"^ABENÇOADA", r"^BABALORIXÁ",
    r"^IALORIXÁ", r"^OGUM", r"^EXÚ", r"^IANSÃ", r"^YANSÃ", r"^IEMANJÁ",
    r"^OBALUAÊ", r"^OXALÁ", r"^OMULU", r"^OXÓSSI", r"^OXUM", r"^OXUMARÉ",
    r"^XANGÔ",
]

# Regular expressions for names on the ballot, security theme.
SECURITY_NAMES = [
    r"^AGENTE", r"^AGT\.", r"ASPIRANTE", r"^ASPIRANTE A OFICIAL", r"BOMBEIRO", r"BOMBEIRA",
    r"^CABO", r"CAPITÃO", r"CAPITAO", r"^CAP\.", r"^CAP ", r"^CAPITÂ", r"^CAPITA",
    r"^CB", r"^CB\.", r"^CEL\s", r"^CEL\.", r"^CORONEL", r"COMANDANTE", r"^CTE ",
    r"DELE\.", r"DELEGADA", r"DELEGADO", r"DETETIVE", r"GCM", r"GCM\.", r"^GENERAL",
    r"INSPETOR", r"INSTRUTOR", r"INVESTIGADOR", r"MAJOR", r"PM", r"POLICIAL",
    r"POLICIALFEDERAL", r"SARGENTO", r"^SARGENTA", r"SARG\.", r"^SGTO", r"^SGT\.",
    r"^SGT ", r"^SD", r"^SD\.", r"SOLDADO\s", r"^SUB", r"SUBO FICIAL", r"SUBOFICIAL",
    r"^SUBTEN", r"^SUB TEN", r"^ST\s", r"SUBTENENTE", r"SUB TENENTE", r"^T C",
    r"^T\. C\.", r"^T\. C\. CORONEL", r"^TEN\.", r"TENENTE", r"TENENTE CORONEL",
    r"TC CORONEL", r"TCORONEL", r"TEN CORONEL", r"TEN\. CEL", r"TEN\. CORONEL",
    r"^GENERAL DE EXÉRCITO", r"^GENERAL DE DIVISÃO", r"^GENERAL DE BRIGADA",
    r"^TENENTE-CORONEL", r"^PRIMEIRO-TENENTE", r"^SEGUNDO-TENENTE", r"^CADETE",
    r"^PRIMEIRO-SARGENTO", r"^SEGUNDO-SARGENTO", r"^TERCEIRO-SARGENTO",
    r"^ALMIRANTE", r"^ALMIRANTE DE ESQUADRA", r"^VICE-ALMIRANTE", r"^CONTRA-ALMIRANTE",
    r"^CAPITÃO DE MAR E GUERRA", r"^CAPITÃO DE FRAGATA", r"^CAPITÃO DE CORVETA",
    r"^CAPITÃO-TENENTE", r"^GUARDA-MARINHA", r"^MARINHEIRO", r"^MARECHAL DO AR",
    r"^TENENTE-BRIGADEIRO", r"^MAJOR-BRIGADEIRO", r"^BRIGADEIRO", r"^PRAÇA",
    r"^POLÍCIA",
]

# Declared occupations, found anywhere in the text, security theme.
SECURITY_OCCUPATIONS = [
    "POLICIAL CIVIL", "POLICIAL MILITAR", "BOMBEIRO CIVIL", "MILITAR REFORMADO",
    "BOMBEIRO MILITAR", "MEMBRO DAS FORÇAS ARMADAS", "DELEGADO DE POLICIA",
    "OFICIAIS DAS FORÇAS ARMADAS E FORÇAS AUXILIARES", "MILITAR EM GERAL",
]

# Declared occupations, found anywhere in the text, religious theme.
RELIGIOUS_OCCUPATIONS = [
    "SACERDOTE OU MEMBRO DE ORDEM OU SEITA RELIGIOSA",
    "SACERDOTE OU MEMBRO DE ORDENS OU SEITAS RELIGIOSAS",
]

# Outcomes.
ELECTED = "ELEITO"
NOT_ELECTED = "NÃO ELEITO"
OUTCOME_GROUPS = {ELECTED: ["ELEITO POR QP", "ELEITO POR MÉDIA"]}
OUTCOME_NULLS = ["#NULO#", "#NULO"]

# Personal labels.
GENDERS = ["MASCULINO", "FEMININO"]
EDUCATION_GROUPS = {
    "Até EF": ["LÊ E ESCREVE", "ENSINO FUNDAMENTAL COMPLETO", "ENSINO FUNDAMENTAL INCOMPLETO"],
    "Até EM": ["ENSINO MÉDIO COMPLETO", "ENSINO MÉDIO INCOMPLETO"],
    "Até Sup.": ["SUPERIOR INCOMPLETO", "SUPERIOR COMPLETO"],
}
MARITAL_GROUPS = {"SOLTEIRO(A)": ["SOLTEIRO(A)"], "CASADO(A)": ["CASADO(A)"]}
MARITAL_OTHER = "OUTRO"
RACE_UNKNOWN = ["#NE#", "NÃO INFORMADO"]
RACE_GROUPS = {
    "BRANCA": ["BRANCA", "AMARELA"],
    "NÃO BRANCA": ["PRETA", "PARDA", "INDÍGENA"],
}

# Party acronyms per position.
SPECTRUM_PARTIES = {
    "Esquerda": ["PSOL", "PCO", "PCB", "PSTU", "PT", "PC do B", "PDT", "PSB", "UP"],
    "Centro": ["REDE", "PPS", "PV"],
    "Direita": [
        "PTB", "AVANTE", "SD", "PMN", "PMB", "PSD", "PSDB", "PMDB", "PHS", "PODE", "PPL", "PRTB",
        "PTC", "PR", "PRP", "PROS", "DC", "Progressistas", "PSL", "NOVO", "DEM", "PATRIOTA", "PSC",
        "PRB", "PL", "SOLIDARIEDADE", "MDB", "REPUBLICANOS", "CIDADANIA", "UNIÃO", "AGIR",
        "PT do B", "PTN", "PSDC", "PP",
    ],
}

# States per region.
REGION_STATES = {
    "NORTE": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "NORDESTE": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "CENTRO-OESTE": ["DF", "GO", "MS", "MT"],
    "SUDESTE": ["ES", "MG", "RJ", "SP"],
    "SUL": ["PR", "RS", "SC"],
}
REGION_UNKNOWN = "DESCONHECIDA"

# Birth dates and age bands; the dash is U+2013.
DATE_FORMAT = "dd/MM/yyyy"
AGE_EDGES = [30, 45, 60]
AGE_LABELS = ["18–29", "30–44", "45–59", "60+"]
AGE_UNKNOWN = "Desconhecida"

# Columns and codes of the feature table.
MODEL_COLUMNS = [
    "DS_SIT_TOT_TURNO", "DS_GENERO", "DS_GRAU_INSTRUCAO", "DS_ESTADO_CIVIL", "DS_COR_RACA",
    "RELIGIOSOS", "SEGURANCA", "ESPECTRO_POL", "FAIXA_ETARIA", "ANO_ELEICAO", "REGIAO",
]
EDUCATION_CODES = {"Até EF": 1, "Até EM": 2, "Até Sup.": 3}
AGE_CODES = {"18–29": 1, "30–44": 2, "45–59": 3, "60+": 4}

# Display labels of the coded columns.
LABELS = {
    "DS_SIT_TOT_TURNO": {0: "não eleito", 1: "eleito"},
    "DS_GENERO": {0: "feminino", 1: "masculino"},
    "DS_COR_RACA": {0: "não branca", 1: "branca"},
    "RELIGIOSOS": {0: "não", 1: "sim"},
    "SEGURANCA": {0: "não", 1: "sim"},
    "DS_GRAU_INSTRUCAO_2": {0: "não EM", 1: "EM"},
    "DS_GRAU_INSTRUCAO_3": {0: "não ES", 1: "ES"},
    "FAIXA_ETARIA_2": {0: "não 30-44", 1: "30-44"},
    "FAIXA_ETARIA_3": {0: "não 45-59", 1: "45-59"},
    "FAIXA_ETARIA_4": {0: "não 60+", 1: "60+"},
    "ESPECTRO_POL_Direita": {0: "não", 1: "sim"},
    "ESPECTRO_POL_Esquerda": {0: "não", 1: "sim"},
    "ANO_ELEICAO": {2014: "2014", 2018: "2018", 2022: "2022"},
    "DS_ESTADO_CIVIL_CASADO(A)": {0: "não", 1: "sim"},
    "DS_ESTADO_CIVIL_OUTRO": {0: "não", 1: "sim"},
    "REGIAO_NORTE": {0: "não", 1: "sim"},
    "REGIAO_NORDESTE": {0: "não", 1: "sim"},
    "REGIAO_CENTRO-OESTE": {0: "não", 1: "sim"},
    "REGIAO_SUL": {0: "não", 1: "sim"},
}

# Forest settings and search grids per office; "all" stands for no limit on the
# predictors tried.
FOREST = {"trees": 100, "depth": 20, "max_features": "sqrt", "min_leaf": 1, "min_split": 10}
GRIDS = {
    STATE: {
        "trees": [300, 400, 500, 600],
        "depth": [5, 10, 15, 20, 25],
        "max_features": ["sqrt", "log2", "all"],
        "min_split": [2, 10, 50],
        "min_leaf": [1, 5, 10],
    },
    FEDERAL: {
        "trees": [100, 200, 300, 400],
        "depth": [10, 15, 20],
        "max_features": ["sqrt", "log2", "all"],
        "min_split": [10, 50, 80],
        "min_leaf": [1, 5, 10],
    },
}
FOLDS = 5
