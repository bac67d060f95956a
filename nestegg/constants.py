"""Lookup constants shared by every operator.

FIXED VALUES. Everything between the two markers below must equal the
behaviour being reproduced (keywords, score tables, class names, sentence
templates, survey wording). They are stated plainly and in their natural
order; nothing here is derived.
"""

# ---- FIXED VALUES: begin -------------------------------------------------

# Risk classes, most conservative first.
STABLE = "안정형"
STABLE_SEEKING = "안정추구형"
NEUTRAL = "위험중립형"
ACTIVE = "적극투자형"
AGGRESSIVE = "공격투자형"
# The guaranteed-product tables are keyed by this spelling, which the profile
# never emits; the aggressive class therefore falls to the table defaults.
AGGRESSIVE_SHORT = "공격형"

RISK_CLASSES = [STABLE, STABLE_SEEKING, NEUTRAL, ACTIVE, AGGRESSIVE]

# Share of principal-guaranteed products per class (default 0.85).
GUARANTEED_SHARE = {
    STABLE: 0.85,
    STABLE_SEEKING: 0.75,
    NEUTRAL: 0.60,
    ACTIVE: 0.45,
    AGGRESSIVE: 0.30,
}
GUARANTEED_SHARE_DEFAULT = 0.85

# Guaranteed products: keywords looked up in the product name.
SAFE_KEYWORDS = ["정부보증채", "은행 예적금", "증권금융회사 예탁금"]
RISKY_KEYWORDS = [
    "저축은행 예적금",
    "발행어음 및 표지어음",
    "원리금파생상품결합사채",
    "금리연동형 보험",
    "이율보증형 보험",
    "환매조건부 매수계약",
]

# Guaranteed product-fit score by class (default 60), and rate weight (default 0.8).
SAFE_FIT = {STABLE: 100, STABLE_SEEKING: 80, NEUTRAL: 60, ACTIVE: 40, AGGRESSIVE_SHORT: 20}
RISKY_FIT = {STABLE: 20, STABLE_SEEKING: 40, NEUTRAL: 60, ACTIVE: 80, AGGRESSIVE_SHORT: 100}
FIT_DEFAULT = 60
RATE_WEIGHT = {STABLE: 0.6, STABLE_SEEKING: 0.7, NEUTRAL: 0.8, ACTIVE: 0.9, AGGRESSIVE_SHORT: 1.0}
RATE_WEIGHT_DEFAULT = 0.8
GUARANTEED_FIT_WEIGHT = 0.7
GUARANTEED_RATE_WEIGHT = 0.3

# Variable products: score by (class, risk level 1..6).
RISK_LEVEL_MATRIX = {
    AGGRESSIVE: [100, 100, 100, 80, 60, 30],
    ACTIVE: [0, 100, 100, 80, 60, 30],
    NEUTRAL: [0, 0, 100, 100, 80, 60],
    STABLE_SEEKING: [0, 0, 0, 100, 100, 80],
    STABLE: [0, 0, 0, 0, 100, 100],
}
RISK_LEVEL_DEFAULT_CLASS = NEUTRAL
RISK_LEVEL_NO_DIGITS = 6

# Management style and its TDF fit (default 50).
MANAGE_EXPERT = "전적으로 전문가에게 맡기고 싶다"
MANAGE_ADVICE = "조언을 받아 내가 결정하고 싶다"
MANAGE_SELF = "내가 직접 알아보고 투자하고 싶다"
TDF_FIT = {MANAGE_EXPERT: 100, MANAGE_ADVICE: 50, MANAGE_SELF: 0}
TDF_FIT_DEFAULT = 50

# Weights of (R, F, C, T, A, S).
WEIGHTS_SILVER = {"R": 0.28, "F": 0.30, "C": 0.15, "T": 0.15, "A": 0.08, "S": 0.04}
WEIGHTS_NORMAL = {"R": 0.38, "F": 0.20, "C": 0.15, "T": 0.15, "A": 0.08, "S": 0.04}

# Return weights (1y, 3y, 5y): all present / 5y missing.
RETURN_WEIGHTS_SILVER = (0.6, 0.2, 0.2)
RETURN_WEIGHTS_SILVER_NO5 = (0.75, 0.25)
RETURN_WEIGHTS_NORMAL = (0.2, 0.4, 0.4)
RETURN_WEIGHTS_NORMAL_NO5 = (0.3, 0.7)

# Launch age (years) -> score: >=10, >=7, >=5, >=3, >=1, else.
AGE_BUCKETS = [(10, 100), (7, 80), (5, 60), (3, 40), (1, 20)]
DAYS_PER_YEAR = 365.25

SILVER_MAX_PERIOD = 5
DEFAULT_PERIOD = 10
DEFAULT_AMOUNT = 0
DEFAULT_RISK = NEUTRAL
DEFAULT_DIRECT_MANAGE = True

# Guaranteed reasons: fit sentence, most aligned to least aligned.
FIT_MATCH = "위험 선호 성향과 일치합니다."
FIT_MOSTLY = "위험 선호 성향과 전반적으로 일치합니다."
FIT_PARTLY = "위험 선호 성향과 일부 일치합니다."
FIT_PARTLY_OFF = "위험 선호 성향과 일부 차이가 있습니다."
FIT_OFF = "위험 선호 성향과 차이가 있습니다."
# Rate sentence: level >= 80, >= 50, else.
RATE_HIGH = "동일 유형 상품 대비 금리가 유리한 편입니다"
RATE_MID = "평균 수준의 금리를 제공하는 상품입니다"
RATE_LOW = "금리는 다소 낮지만 안정성이 강조된 상품입니다"
# Class templates; "%s" is the rate sentence. The last one is for any other class.
RATE_TEMPLATES = {
    STABLE: "원리금이 보장되는 안정적인 상품으로, %s 포트폴리오의 안정성을 높이는 데 적합합니다",
    STABLE_SEEKING: "안정성을 확보하면서도 %s 포트폴리오에서 리스크를 낮추는 역할을 합니다",
    NEUTRAL: "%s 안정적인 자산으로, 수익형 자산과 함께 균형 잡힌 포트폴리오 구성이 가능합니다",
    ACTIVE: "수익성은 제한적이지만 %s 포트폴리오의 변동성을 낮추는 안정 자산으로 활용할 수 있습니다",
}
RATE_TEMPLATE_OTHER = "원리금이 보장되는 상품으로, %s 포트폴리오의 안정적인 기반을 제공합니다"

# Variable reasons, in rule order. "%s" placeholders: class, level, period.
VR_F_EXACT = "고객님의 '%s' 성향에 딱 맞는 위험등급(%s등급)을 가진 상품입니다."
VR_F_BROAD = "고객님의 '%s' 성향과 전반적으로 부합하는 수준의 위험도를 가졌습니다."
VR_F_SOME = "고객님의 성향 대비 다소 보수적이거나 위험도가 높지만, 포트폴리오 다변화 측면에서 긍정적입니다."
VR_R_TOP = "동일 유형 상품 대비 장기(1·3·5년) 수익률 성과가 최상위 수준으로 매우 우수합니다."
VR_R_GOOD = "시장 평균 이상의 양호하고 안정적인 장기 수익률을 기록하고 있습니다."
VR_R_OTHER = "최근 수익률 성과는 보통 수준이나, 안정성 및 수수료 등 다른 지표가 뛰어납니다."
VR_C_LOW = "총보수(수수료)가 매우 저렴하여, 연금처럼 장기 투자할 때 복리 효과를 극대화하기 좋습니다."
VR_C_FAIR = "상품의 총보수가 시장 평균 수준으로 합리적입니다."
VR_TDF = "자산을 직접 관리하기보다 전문가에게 맡기고자 하는 고객님의 니즈에 맞춘 TDF 상품으로, 생애주기에 맞춰 알아서 자산 비중을 조절해 주어 편리합니다."
VR_SIZE_AGE = "설정된 지 오래되었고 순자산 규모가 커서, 위기 상황에서도 흔들림 없이 안정적인 운용을 기대할 수 있습니다."
VR_SILVER = "💡 [실버 모드 적용] 투자 여유 기간이 %s년 이하이신 점을 고려하여, 최근 시장 변동성 방어와 자산 안정성에 더 높은 가중치를 두어 엄선했습니다."

# Product documents.
DOC_HEADER = "[상품 기본 정보]\n- 상품명: %s\n- 상품 유형: %s\n- 상품 구분: %s\n"
DOC_KIND_GUARANTEED = "원리금 보장형"
DOC_KIND_VARIABLE = "실적 배당형(비보장형)"
DOC_GUARANTEED = (
    "\n[수익 및 금리 안내]\n- 만기: %s개월\n- 적용 이율(금리): %s%%\n"
    "- 특징: 만기 시 원금과 약정된 이율을 보장하는 안전한 상품입니다.\n"
)
DOC_VARIABLE = (
    "\n[상품 상세 스펙]\n- 위험 등급: %s\n- TDF 편입 여부: %s\n- 상품 설정일: %s\n- 순자산 규모: %s\n"
    "- 총 보수(수수료율): %s%%\n\n[과거 평균 수익률 내역]\n- 최근 1년 수익률: %s%%\n"
    "- 최근 3년 수익률: %s%%\n- 최근 5년 수익률: %s%%\n* 주의: 과거 수익률이 미래의 수익을 보장하지 않습니다.\n"
)
DOC_TDF_IN = "편입(O)"
DOC_TDF_OUT = "미편입(X)"

# Portfolio context.
CTX_SUMMARY = "[투자 요약]\n- 투자성향: %s\n- 총 투자금: %s원\n- 자산배분: 원리금보장형 %s%% / 실적배당형 %s%%\n\n"
CTX_GUARANTEED_HEAD = "[원리금 보장형 추천]\n"
CTX_VARIABLE_HEAD = "\n[실적 배당형(비보장형) 추천]\n"
CTX_ITEM = "%s위. %s (점수: %s점) - 특징: %s\n"
REASON_BLOCK_HEAD = "[시스템 추천 사유]\n"
REASON_BLOCK_ITEM = "■ %s (추천 점수: %s점)\n  - %s\n\n"

# Intent and recommendation-request literals.
COMPARE_WORDS = ["비교", "차이"]
RECOMMEND_REQUESTS = ["추천", "추천해주세요", "상품 추천", "포트폴리오 추천"]
FOLLOWUP_QUERY = "이 상품들의 특징과 차이"


# Chat prompt (system + human).
CHAT_SYSTEM = """
        너는 전문적이고 친절한 퇴직연금 AI 어드바이저다.

        다음 규칙을 반드시 지켜라:
        1. 상품명(예: TDF, ETF 등)이나 필수 금융 용어를 제외하고는 100% 자연스러운 한국어로 작성한다.
        2. 한글과 영어를 제외한 문자는 무조건 사용해서는 안 된다. 해당 규칙을 어길 경우 잘못된 대답이다.
        3. 고객에게 존댓말을 사용하며 신뢰감 있는 말투를 사용한다.
        4. 제공된 [시스템 추천 사유]와 [검색된 상세 정보]만을 바탕으로 답변한다.
        5. 고객의 질문에 직접적으로 답하면서, 왜 이 상품이 추천되었는지 명확히 설명한다.
        """
CHAT_HUMAN = """
        [고객 정보]
        - 나이: %s세
        - 투자 성향: %s
        - 은퇴까지 남은 기간: %s년

        [고객의 실제 질문]
        "%s"

        [추천 데이터 및 상세 정보]
        %s

        위 정보를 바탕으로 고객의 질문에 완벽하게 답변해 주세요.
        """
CONTEXT_RECOMMEND = """
        [추천 포트폴리오]
        %s

        [추가 정보]
        %s
        """
CONTEXT_QUESTION = """
        %s

        %s

        [검색된 상세 정보]
        %s
        """
ADVICE_PROMPT = """
    너는 고객의 퇴직연금을 관리해주는 AI 어드바이저야.
    아래 [추천 포트폴리오]는 백엔드 시스템이 철저한 계산을 통해 뽑아낸 결과야.
    이 데이터를 바탕으로 고객의 질문에 친절하고 전문적으로 답해줘.

    [추천 포트폴리오]
    %s

    고객 질문: "%s"
    """
QUESTION_PROMPT = """
    사용자 정보:
    %s

    추천 상품:
    %s

    상품 상세 정보:
    %s

    위 정보를 기반으로
    사용자가 다음으로 물어볼 만한 질문 3개를 생성하세요.

    조건:
    - 반드시 질문 문장만 출력
    - 설명 금지
    - 번호 금지
    - 중복 금지
    - 구체적인 질문
    - 무조건 한국어
    - 한국어와 필요시 영어 사용을 제외한 다른 언어는 잘못된 출력값임
    """
LIST_CONTEXT_ITEM = """
        상품명: %s
        금리: %s
        위험도: %s
        추천 이유: %s
        """
COMPARISON_CONTEXT_ITEM = """
        상품명: %s
        금리: %s%%
        위험도: %s
        특징: %s
        """
QUESTION_MIN_LEN = 5
QUESTION_COUNT = 3

# Survey: step order, step labels (None = use the question label), questions and options.
SURVEY_STEPS = [
    ("age", "나이(만 나이 기준)", "number"),
    ("period", "은퇴까지 남은 기간(년)", "number"),
    ("experience", None, "radio"),
    ("psychology", None, "radio"),
    ("loss_level", None, "radio"),
    ("finance_knowledge", None, "radio"),
    ("investment_goal", None, "radio"),
    ("pension_ratio", None, "radio"),
    ("expected_income", None, "radio"),
    ("investment_amount", "투자금액(DC 연금계좌에 적립된 퇴직금 금액/만원)", "number"),
    ("pension_operator", "가입한 퇴직연금사업자", "text_match"),
    ("direct_manage", None, "radio"),
]
SURVEY_QUESTIONS = {
    "experience": (
        "투자 경험을 기준으로 본인의 수준은 어느 정도인가요? (여러 경험이 있다면 가장 높은 위험 수준을 선택해주세요)",
        [
            "1. 고위험 투자(파생상품, 레버리지 투자 등 변동성이 큰 투자) 경험이 있음",
            "2. 주식 투자(주식 또는 원금 비보장 상품) 경험이 있음",
            "3. 펀드, ETF 등 간접투자 경험이 있음",
            "4. 안정형 금융상품(채권, 채권형 펀드) 투자 경험이 있음",
            "5. 예적금 위주로 금융상품 이용",
            "6. 투자 경험 없음",
        ],
    ),
    "psychology": (
        "투자 손실이 발생했을 때 어떻게 행동하시겠습니까?",
        [
            "1. 추가 투자하여 손실 회복을 시도한다.",
            "2. 당장 매도하지 않고 상황을 지켜본다.",
            "3. 손실 확대를 막기 위해 안전자산으로 옮긴다.",
        ],
    ),
    "loss_level": (
        "감내 가능한 손실 수준은 어느 정도인가요?",
        [
            "1. 원금 보존",
            "2. 최소한의 손실만 (5% 이내) 감수",
            "3. 일부 손실 (5~15%) 감수 가능",
            "4. 수익이 높다면 위험은 상관 없음",
        ],
    ),
    "finance_knowledge": (
        "투자상품을 선택할 때 본인 수준에 가장 가까운 것을 선택해주세요.",
        [
            "1. 상품 구조와 위험을 직접 비교하고 투자 결정을 할 수 있다. (예: 수익률, 위험도, 수수료 비교)",
            "2. 상품 설명을 읽으면 위험 수준은 이해할 수 있지만 투자 결정은 어렵다",
            "3. 기본적인 상품(예금, 펀드 등)은 이해하지만 복잡한 상품은 어렵다",
            "4. 상품 설명을 읽어도 이해하기 어려워 추천에 의존한다",
        ],
    ),
    "investment_goal": (
        "주된 투자 목적은 무엇인가요?",
        ["1. 자산 증식", "2. 노후 준비", "3. 예적금보다 높은 수익", "4. 세액공제"],
    ),
    "pension_ratio": (
        "전체 노후 자산 중 퇴직연금이 차지하는 비중이 어느 정도인가요?",
        ["1. 10% 미만", "2. 10~40%", "3. 40~70%", "4. 70% 이상"],
    ),
    "expected_income": (
        "향후 수입원에 대한 예상은 어떠신가요?",
        [
            "1. 현재 소득이 일정하며, 향후 상당 기간 유지 또는 증가 예상",
            "2. 현재 소득은 일정하지만, 향후 감소하거나 불안정할 것으로 예상",
            "3. 현재 일정한 소득이 없음",
        ],
    ),
    "direct_manage": (
        "선호하는 투자 관리 방식은 무엇인가요?",
        ["1. 내가 직접 관리", "2. 전문가에게 맡김"],
    ),
}
AMOUNT_UNIT = 10000
FUZZY_TOP = 3
FUZZY_CUTOFF = 0.4

# Risk-score terms: (lower bound inclusive, upper bound inclusive, points), else points.
AGE_POINTS = [(19, 34, 10), (35, 44, 8), (45, 54, 6), (55, 64, 4)]
AGE_POINTS_ELSE = 2
# Period: at least the bound.
PERIOD_POINTS = [(10, 15), (5, 12), (3, 8), (1, 4)]
PERIOD_POINTS_ELSE = 2
EXPERIENCE_POINTS = {1: 15, 2: 12, 3: 9, 4: 6, 5: 3}
EXPERIENCE_POINTS_ELSE = 1
PSYCHOLOGY_POINTS = {1: 10, 2: 5}
PSYCHOLOGY_POINTS_ELSE = 1
LOSS_POINTS = {2: 8, 3: 14, 4: 20}
LOSS_POINTS_ELSE = 0
KNOWLEDGE_POINTS = {1: 10, 2: 7, 3: 4}
KNOWLEDGE_POINTS_ELSE = 1
GOAL_POINTS = {1: 5, 2: 4, 3: 2, 4: 1}
GOAL_POINTS_ELSE = 0
PENSION_RATIO_POINTS = {1: 10, 2: 7, 3: 4}
PENSION_RATIO_POINTS_ELSE = 1
INCOME_POINTS = {1: 5, 2: 3}
INCOME_POINTS_ELSE = 1
# Class by score: at most the bound. Above the last bound: aggressive.
CLASS_BOUNDS = [(30, STABLE), (50, STABLE_SEEKING), (70, NEUTRAL), (90, ACTIVE)]
LOSS_LEVEL_FORCE_STABLE = 1
LOSS_LEVEL_CAP_NEUTRAL = 2

# ---- FIXED VALUES: end ---------------------------------------------------

SURVEY_KEYS = [k for k, _, _ in SURVEY_STEPS]
