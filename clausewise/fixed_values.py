"""Word lists, patterns, lookup tables and message formats.

Everything in this module is a constant that results depend on.  Nothing here is
code; ``dims.py`` turns these values into dimension tables, and every operator takes
the dimension as a parameter, so another language or domain only passes other rows.
Rule patterns are plain regular expressions in the common subset of Java and RE2
syntax (one loan pattern needs a look-ahead).
"""

# --- rule patterns and veto phrases -----------------------------------------------

SAFE_RULES = [  # (contract type, pattern, reason), tried in this order
    ("lease", r"소재지\s*:.*면적\s*:", "목적물 식별 기재"),
    ("lease", r"보증금[^.]{0,80}(?:차임|월세|월\s*차임)[^.]{0,80}임대(?:한다|함|하기로)", "단순 임대 조건 기재"),
    ("lease", r"보증금[^.]{0,80}임대(?:한다|함|하기로|하며|하고)", "단순 임대 조건 기재"),
    ("lease", r"보증금\s*[:：][^.\n]{0,80}(?:월\s*)?차임\s*[:：][^.\n]{0,100}(?:지불|지급)", "보증금·차임 금액 및 지급 일정 기재"),
    ("lease", r"연\s*5\s*%\s*(?:를|이내|이하|를\s*초과하지\s*않)", "법정 증액 한도 준수"),
    ("lease", r"주택임대차보호법.*연\s*5\s*%", "법정 증액 한도 준수"),
    ("lease", r"(?:통상적인\s*사용|자연\s*마모|경년\s*변화).*제외", "자연마모 제외"),
    ("lease", r"임대인.*(?:주요|구조|설비|보일러|배관|누수).*수선.*임차인.*(?:소모품|소규모)", "법정 수선 의무 분담"),
    ("lease", r"임대인의?\s*(?:서면\s*)?동의(?:\s*없이|\s*를?\s*받지\s*않)[^.]{0,80}(?:양도|전대|전매)", "법률상 당연한 전대 제한"),
    ("lease", r"임차권(?:을|이)?[^.]{0,30}(?:양도|전대|전매)[^.]{0,40}(?:할\s*수\s*없|하지\s*못|아니\s*된다|금지|금한)", "법률상 당연한 전대 제한"),
    ("lease", r"임차인은?\s*선(?:량한\s*관리자의?|관)\s*주의", "법률상 선관주의 의무"),
    ("lease", r"임차물(?:의\s*수리|에\s*권리)[^.]{0,40}임대인에(?:게)?\s*통지", "법률상 통지 의무"),
    ("lease", r"(?:갑과\s*을|쌍방|당사자)[^.]{0,30}(?:합의|협의)[^.]{0,80}(?:조정|변경|변동)", "쌍방 합의에 의한 조건 변경"),
    ("lease", r"다음\s*각\s*호[^.]{0,40}(?:해당[^.]{0,15}경우)[^.]{0,60}(?:조정|변경|변동)할\s*수\s*있", "각호 사유에 한정된 조건 변경"),
    ("lease", r"(?:개축|증축|변경)[^.]{0,40}(?:임대인의?\s*동의|승낙)[^.]{0,15}(?:없이|받지\s*않)[^.]{0,40}(?:할\s*수\s*없|하지\s*못|아니\s*된다)", "법률상 보존 의무 (개축·증축 동의)"),
    ("sales", r"(?:잔금|매매대금)[^.]{0,30}(?:지급|지불)[^.]{0,30}(?:소유권\s*이전|등기)[^.]{0,20}동시(?:\s*이행)?", "동시이행 원칙 준수"),
    ("sales", r"동시\s*이행[^.]{0,30}(?:잔금|등기|소유권)", "동시이행 원칙 준수"),
    ("sales", r"계약금[^.]{0,40}(?:배액[^.]{0,20}상환|포기)[^.]{0,40}(?:해제|해약)", "민법상 해약금 조항"),
    ("sales", r"(?:갑|매도인)은?[^.]{0,30}(?:을|매수인)에(?:게)?[^.]{0,30}(?:매매|매도)(?:한다|함|하기로)", "단순 매매 사실 기재"),
    ("employment", r"(?:해고|면직)[^.]{0,40}30\s*일\s*전(?:에|까지)?[^.]{0,30}예고", "법정 해고예고 기간 준수"),
    ("employment", r"30\s*일\s*분\s*이상[^.]{0,15}(?:통상임금|임금)[^.]{0,15}(?:지급|지불)", "법정 해고예고수당 준수"),
    ("employment", r"(?:주|1주)\s*(?:40|사십)\s*시간[^.]{0,15}(?:이내|초과하지)", "법정 근로시간 준수"),
    ("employment", r"1일\s*(?:8|여덟)\s*시간[^.]{0,15}(?:이내|초과하지)", "법정 근로시간 준수"),
    ("employment", r"(?:연장|야간|휴일)[^.]{0,15}근로[^.]{0,30}(?:50|오십)\s*(?:%|퍼센트|분의\s*50|100분의\s*50)\s*(?:이상)?\s*가산", "법정 가산수당 준수"),
    ("employment", r"(?:1년|일년)[^.]{0,15}(?:80|팔십)\s*(?:%|퍼센트)?[^.]{0,15}(?:15|십오)\s*일[^.]{0,15}(?:유급|연차)", "법정 연차유급휴가 준수"),
    ("employment", r"(?:1년|일년|계속근로)[^.]{0,15}(?:30|삼십)\s*일\s*분[^.]{0,30}(?:퇴직금|퇴직\s*급여|평균임금)", "법정 퇴직금 기준 준수"),
    ("service", r"(?:대금|보수|용역\s*대금|도급\s*대금)[^.]{0,40}(?:60|육십)\s*일\s*이내[^.]{0,15}(?:지급|지불)", "법정 대금 지급 기한 준수"),
    ("service", r"(?:60|육십)\s*일\s*이내[^.]{0,30}(?:대금|보수)[^.]{0,15}(?:지급|지불)", "법정 대금 지급 기한 준수"),
    ("service", r"(?:하자\s*담보|담보\s*책임)[^.]{0,40}(?:1년|일년|12개월)\s*(?:내|이내)", "법정 하자담보 기간 준수"),
    ("service", r"(?:완성|인도)[^.]{0,30}동시(?:\s*이행)?[^.]{0,30}(?:보수|대금)\s*지급", "법정 보수 지급 시기 준수"),
    ("loan", r"(?:연|연리|이자율)[^.]{0,10}(?:[1-9]|1[0-9]|20)\s*(?:%|퍼센트|프로)(?!\d)", "법정 이자율 한도 준수"),
    ("loan", r"보증[^.]{0,15}(?:서면|기명날인|서명)[^.]{0,15}(?:으로|효력)", "법정 서면 보증 준수"),
    ("loan", r"(?:근보증|보증\s*최고액)[^.]{0,30}(?:특정|명시|기재)", "법정 근보증 최고액 명시"),
    ("loan", r"(?:차주|을)는?[^.]{0,15}(?:대주|갑)에(?:게)?[^.]{0,30}(?:대여금|차용금|원금)[^.]{0,30}(?:변제|상환|반환)", "단순 대여·변제 사실 기재"),
]

HIGH_RULES = [  # (contract type, pattern, risk type, reason), tried in this order
    ("lease", r"(?:차임|월세|보증금).*(?:최대\s*)?(?:[2-9][0-9]|[1-9][0-9]{2,})\s*%.*증액", "차임증액_무제한", "법정 한도(연 5%) 초과 증액을 허용"),
    ("lease", r"증액[^.]{0,10}(?:상한|제한|한도)[^.]{0,15}(?:없|두지\s*않)", "차임증액_무제한", "증액 제한 없음을 명시"),
    ("lease", r"(?:반환|지급).*(?:무기한|유보).*(?:연기|지연)", "보증금_미반환_위험", "보증금 반환 무기한 유보/연기 조항"),
    ("lease", r"(?:후순위|대체|새로운)\s*임차인.*(?:반환|지급).*연기", "보증금_미반환_위험", "후순위 임차인 확보 조건부 보증금 반환 지연"),
    ("lease", r"반환.*연기.*이자.*(?:발생하지\s*않|없)", "보증금_미반환_위험", "반환 연기 기간 이자 미지급 조항"),
    ("lease", r"(?:모든|일체).*수(?:선|리).*임차인.*(?:부담|비용)", "수선의무_전가", "모든 수선 비용을 임차인에게 전가"),
    ("lease", r"원인\s*불문.*임차인.*(?:부담|수리)", "수선의무_전가", "원인 불문 임차인 수선 부담"),
    ("lease", r"사전\s*통보\s*없이.*(?:임대인|출입)", "권리제한", "사전 통보 없는 임대인 출입"),
    ("lease", r"본\s*계약에\s*정하지\s*않은\s*사항은?\s*임대인의?\s*(?:결정|판단)", "권리제한", "미기재 사항에 대한 임대인 일방 결정권"),
    ("lease", r"묵시적\s*갱신.*적용\s*(?:안\s*됨|하지\s*않|배제)", "묵시적_갱신_배제", "묵시적 갱신 배제 조항"),
    ("lease", r"갱신\s*요구권을?\s*(?:행사하지\s*않|포기)", "묵시적_갱신_배제", "갱신요구권 포기 조항"),
    ("lease", r"관리비[^.]{0,60}(?:항목|금액|내역)[^.]{0,60}(?:갑이?\s*단독|일방적?\s*으?로\s*결정|임대인이?\s*단독)", "권리제한", "관리비 항목·금액을 임대인이 일방적으로 결정"),
    ("lease", r"관리비[^.]{0,60}(?:세부\s*)?내역[^.]{0,30}공개[^.]{0,30}의무[^.]{0,30}없", "권리제한", "관리비 세부 내역 공개 의무를 면제"),
    ("lease", r"확정일자[^.]{0,30}(?:갑|임대인)[^.]{0,15}(?:서면\s*)?동의", "권리제한", "확정일자 부여에 임대인 동의를 강요 (우선변제권 침해)"),
    ("service", r"(?:대금|보수|용역\s*대금|도급\s*대금|하도급\s*대금)[^.]{0,60}(?:6[1-9]|[7-9][0-9]|[1-9][0-9]{2,})\s*일[^.]{0,20}(?:이내|이후)?[^.]{0,20}지(?:급|불)", "대금지급_지연", "하도급법상 대금 지급 60일 한도를 초과"),
    ("service", r"(?:대금|보수|용역\s*대금|도급\s*대금|하도급\s*대금)[^.]{0,40}(?:지급|지불)[^.]{0,30}(?:6[1-9]|[7-9][0-9]|[1-9][0-9]{2,})\s*일", "대금지급_지연", "하도급법상 대금 지급 60일 한도를 초과"),
    ("service", r"검수[^.]{0,40}(?:무기한|기한\s*없|기한을?\s*정하지\s*않)", "검수_불공정", "검수 기한을 무기한으로 두어 대금 지급을 거부할 수 있는 구조"),
    ("service", r"(?:사양|범위|금액|단가)[^.]{0,30}(?:발주자|갑)[^.]{0,15}(?:일방적?\s*으?로|단독)[^.]{0,15}(?:변경|결정)", "일방적_사양변경", "발주자가 사양·금액을 일방적으로 변경할 수 있는 조항"),
    ("loan", r"(?:연|연리|이자율)[^.]{0,10}(?:2[1-9]|[3-9][0-9]|[1-9][0-9]{2,})\s*(?:%|퍼센트|프로)", "이자_초과", "이자제한법상 연 20% 한도를 초과한 이자율"),
    ("loan", r"월\s*(?:1\.[789]|[2-9]|[1-9][0-9]+)\s*(?:%|퍼센트|프로)", "이자_초과", "월이율 환산 시 이자제한법 연 20% 한도를 초과"),
    ("loan", r"보증[^.]{0,20}(?:구두|구두로|서면\s*없|서면\s*없이)", "보증인_보호위반", "서면 없는 보증은 보증인 보호 특별법상 무효"),
    ("loan", r"기한\s*이익[^.]{0,20}상실[^.]{0,30}(?:통지\s*없|통보\s*없|즉시)", "일방적_기한이익상실", "사전 통지 없는 일방적 기한이익 상실 조항"),
    ("loan", r"(?:즉시|통지\s*없이|통보\s*없이|1\s*회\s*연체)[^.]{0,40}기한\s*이익[^.]{0,15}상실", "일방적_기한이익상실", "사전 통지 없는 일방적 기한이익 상실 조항"),
]

COMMON_VETOES = [
    "즉시 해지", "즉시 퇴거", "즉각", "통보 없이", "통지 없이", "사전 통지 없", "이의제기 불가", "이의를 제기할 수 없", "항변 없이",
    "최고 없이", "기간을 정하지 않", "무제한", "무기한", "무조건", "위약금", "벌금", "과태료", "임대인이 정한", "임대인이 결정", "임대인의 결정",
    "갑이 정한", "갑이 결정", "갑이 단독", "갑의 단독", "갑의 일방", "사용자가 정한", "사용자가 결정", "발주자가 정한", "발주자가 결정",
    "발주자의 단독", "채권자가 정한", "채권자가 결정", "단독으로 결정", "단독 결정", "일방적 결정",
]

LEASE_VETOES = [
    "무기한", "연기할 수", "연기 기간", "후순위", "사전 통보 없이", "사전통보 없이", "임대인의 결정에 따른", "이의제기", "이의를 제기할 수 없",
    "모든 수리", "원인 불문", "즉시 퇴거", "묵시적 갱신 적용 안", "갱신요구권을 행사하지 않", "일방적으로 공제", "일방 공제", "6개월", "6 개월",
]

CONTRACT_TYPE_KEYWORDS = {
    "lease": ["임대차", "임대인", "임차인", "보증금", "차임", "월세", "전세", "임대"],
    "sales": ["매매", "매도인", "매수인", "매매대금", "소유권이전", "잔금"],
    "employment": ["근로", "근로자", "사용자", "임금", "급여", "퇴직", "근무시간", "고용"],
    "service": ["도급", "수급인", "발주자", "발주", "용역", "검수", "납품", "산출물", "하도급", "하도급대금"],
    "loan": ["소비대차", "차용", "차용금", "대여", "대여금", "원금", "이자", "원리금", "변제", "차주", "대주", "기한이익"],
}

RESIDENTIAL_KEYWORDS = [
    "주택", "주거", "주거용", "아파트", "빌라", "오피스텔", "원룸", "투룸", "다가구", "다세대", "전세", "월세",
]

COMMERCIAL_KEYWORDS = [
    "상가", "점포", "사무실", "사업장", "영업용", "영업장", "영업소", "상업용", "사무용", "근린생활시설", "사업자등록", "영업개시", "권리금",
]

LEASE_KEYWORDS = [
    "임대", "임차", "보증금", "차임", "월세", "전세", "임대차", "주택임대",
]

SALES_KEYWORDS = [
    "매매", "매도", "매수", "소유권이전", "잔금", "계약금",
]

PRECEDENT_KEYWORDS = {
    "lease": ["임대차", "임차인", "임대인", "보증금", "차임", "전세권"],
    "sales": ["매매", "매도인", "매수인", "소유권이전", "잔금"],
    "employment": ["근로기준", "임금", "퇴직금", "부당해고", "근로계약", "통상임금", "연차"],
    "service": ["도급", "수급인", "공사대금", "하도급", "용역계약", "기성고", "공사도급"],
    "loan": ["소비대차", "대여금", "차용금", "이자제한", "보증채무", "근보증", "기한이익"],
}

LAW_CONTRACT_TYPES = {
    "주택임대차보호법": ["lease"],
    "상가건물임대차보호법": ["lease"],
    "민법": ["lease", "sales", "service", "loan"],
    "공인중개사법": ["sales"],
    "부동산거래신고등에관한법률": ["sales"],
    "근로기준법": ["employment"],
    "최저임금법": ["employment"],
    "기간제및단시간근로자보호등에관한법률": ["employment"],
    "남녀고용평등과일ㆍ가정양립지원에관한법률": ["employment"],
    "노동조합및노동관계조정법": ["employment"],
    "근로자퇴직급여보장법": ["employment"],
    "산업안전보건법": ["employment"],
    "직업안정법": ["employment"],
    "파견근로자보호등에관한법률": ["employment"],
    "하도급거래공정화에관한법률": ["service"],
    "건설산업기본법": ["service"],
    "이자제한법": ["loan"],
    "대부업등의등록및금융이용자보호에관한법률": ["loan"],
    "보증인보호를위한특별법": ["loan"],
    "약관의규제에관한법률": ["lease", "sales", "employment", "service", "loan"],
    "민사집행법": ["lease"],
}

CIVIL_CODE_RANGES = {
    "lease": (618, 654),
    "sales": (563, 595),
    "service": (664, 674),
    "loan": (598, 608),
}

ROLE_CANDIDATES = {
    "lease": ["임대인", "임차인"],
    "sales": ["매도인", "매수인"],
    "employment": ["사용자", "근로자", "고용주", "사업주"],
    "service": ["발주자", "수급인", "도급인", "원사업자", "수급사업자"],
    "loan": ["대주", "차주", "채권자", "채무자", "대여인", "차용인"],
}

ROLE_SYNONYMS = {
    "고용주": "사용자",
    "사업주": "사용자",
    "도급인": "발주자",
    "원사업자": "발주자",
    "수급사업자": "수급인",
    "채권자": "대주",
    "대여인": "대주",
    "채무자": "차주",
    "차용인": "차주",
}

DEFAULT_PARTIES = {  # contract type: (role of party A, role of party B)
    "lease": ("임대인", "임차인"),
    "sales": ("매도인", "매수인"),
    "employment": ("사용자", "근로자"),
    "service": ("발주자", "수급인"),
    "loan": ("대주", "차주"),
}

QUERY_EXPANSIONS = [  # (contract type, trigger, extra search words)
    ("lease", "청소비", "원상복구 임차인 부담 비용 약관규제법 부당"),
    ("lease", "관리비", "관리비 산정 내역 공개 임대인 일방 결정"),
    ("lease", "중개보수", "중개보수 부담 공인중개사법 임차인 부담"),
    ("lease", "이사", "묵시적 갱신 해지 통지 3개월 임차인 해지권 주임법 제6조의2"),
    ("lease", "새로운 임차인", "묵시적 갱신 해지 통지 3개월 임차인 해지권 주임법 제6조의2"),
    ("lease", "반려동물", "특약 약관규제법 임차인 권리제한"),
    ("lease", "흡연", "특약 임차인 생활 제한"),
    ("lease", "쓰레기", "관리 의무 임차인 부담"),
    ("lease", "연체", "차임연체 해지 주임법 제6조의2 민법 제640조 2기"),
    ("lease", "해지", "차임연체 해지 주임법 제6조의2 민법 제640조"),
    ("lease", "전대", "민법 제629조 무단 전대 임차권 양도"),
    ("lease", "양도", "민법 제629조 무단 전대 임차권 양도"),
    ("lease", "원상회복", "원상복구 자연마모 통상 사용 판례"),
    ("lease", "원상복구", "원상복구 자연마모 통상 사용 판례"),
    ("lease", "계약금", "민법 제565조 해약금 배액상환 포기"),
    ("lease", "증액", "주임법 제7조 차임증감청구권 5%"),
    ("lease", "보증금", "보증금 반환 우선변제권 주임법 제3조의2"),
    ("sales", "하자", "민법 제580조 하자담보책임 매도인 6개월"),
    ("sales", "계약금", "민법 제565조 해약금 배액상환 포기"),
    ("sales", "소유권이전", "동시이행 민법 제536조 이전등기"),
    ("sales", "근저당", "근저당 말소 매도인 부담"),
    ("employment", "위약금", "근로기준법 제20조 위약예정 금지"),
    ("employment", "해고", "근로기준법 제23조 정당사유 제26조 30일 예고"),
    ("employment", "연차", "근로기준법 제60조 연차유급휴가"),
    ("employment", "퇴직", "퇴직급여보장법 제8조 1년 30일분"),
    ("employment", "경업", "경업금지 합리적 범위 보상"),
    ("employment", "비밀유지", "영업비밀 합리적 범위"),
    ("service", "대금", "하도급법 제13조 60일 대금 지급"),
    ("service", "검수", "검수 기간 통지 의무 이의제기"),
    ("service", "지식재산", "산출물 저작권 보상"),
    ("service", "하자", "민법 제667조 수급인 담보책임 1년"),
    ("loan", "이자", "이자제한법 제2조 연 20% 한도"),
    ("loan", "기한이익", "기한이익 상실 통지 시정 기회"),
    ("loan", "보증", "보증인보호특별법 서면 보증 최고액"),
    ("loan", "중도상환", "중도상환 수수료 변제 자유"),
]

SAFE_EXPLANATIONS = {
    "목적물 식별 기재": "임대 목적물의 소재지와 면적을 특정하는 기본 기재 사항으로, 법적 위험이 없는 조항입니다.",
    "단순 임대 조건 기재": "임대 목적물과 보증금·월차임 금액만을 명시한 단순 사실 기재 조항으로, 임차인에게 위험 요소가 없는 기본 조항입니다.",
    "보증금·차임 금액 및 지급 일정 기재": "보증금·차임 금액과 계약금·잔금 지급 일정을 명시한 단순 사실 기재 조항으로, 임차인에게 위험 요소가 없습니다.",
    "단순 금액·납부일정 기재": "보증금, 차임 등 금액과 납부 일정을 기재한 조항으로, 특별한 위험 요소가 없습니다.",
    "종료일 보증금 반환": "임대차 종료 시 보증금 반환을 규정한 조항으로, 임차인의 권리를 보장하는 내용입니다.",
    "법정 증액 한도 준수": "주택임대차보호법 제7조에 따른 연 5% 이내 증액 한도를 준수하고 있어 안전합니다.",
    "자연마모 제외": "통상적인 사용에 따른 자연마모를 원상복구 대상에서 제외하여 임차인을 보호하는 조항입니다.",
    "법률상 당연한 전대 제한": "민법상 임대인의 동의 없는 전대·양도를 제한하는 것은 법률상 당연한 규정입니다.",
    "법정 수선 의무 분담": "민법 제623조에 따라 주요 수선은 임대인, 소규모 수선은 임차인이 부담하는 합리적 분담입니다.",
    "갱신요구권 인정": "임차인의 계약 갱신 요구권을 인정하는 조항으로, 임차인 보호에 부합합니다.",
}

HIGH_EXPLANATIONS = {
    "차임증액_무제한": "주택임대차보호법상 연 5% 한도를 초과하는 증액을 허용하고 있어, 임차인에게 과도한 부담이 될 수 있습니다.",
    "보증금_미반환_위험": "보증금 반환이 지연되거나 거부될 수 있는 조건이 포함되어 있어, 임차인의 보증금 회수에 위험이 있습니다.",
    "수선의무_전가": "임대인이 부담해야 할 수선 의무를 임차인에게 전가하고 있어, 민법 제623조에 반하는 불공정한 조항입니다.",
    "권리제한": "임차인의 정당한 권리를 부당하게 제한하거나, 임대인에게 과도한 재량권을 부여하는 조항입니다.",
    "묵시적_갱신_배제": "주택임대차보호법상 보장되는 묵시적 갱신 또는 갱신요구권을 배제하는 조항으로, 임차인에게 불리합니다.",
}

SUBTYPE_HINTS = {
    "residential": (
        "## 적용 법령 힌트 (반드시 준수)\n"
        "이 계약은 주거용 부동산 임대차로 판단됩니다. **주택임대차보호법(주임법)**이 우선 적용됩니다.\n"
        "- 차임 연체 해지: 주임법 제6조의2 / 민법 제640조 — **2기** 연체 시 해지 가능 (법대로의 기준)\n"
        "- 묵시적 갱신: 임차인은 언제든 해지 통지 가능, 통지 후 3개월 후 효력 (주임법 제6조의2)\n"
        "- 차임 증액: 약정 차임의 5% 이내 (주임법 제7조)\n"
        "- 임차권등기명령·우선변제권: 주임법 제3조·제3조의2\n"
        "- 갱신요구권: 임차인은 1회 갱신 요구 가능 (주임법 제6조의3)\n"
        "조항 내용이 위 법률 기준과 동일하면 위험으로 평가하지 마세요. 상가건물임대차보호법(상임법, 3기 기준)은 **적용되지 않습니다**.\n"
    ),
    "commercial": (
        "## 적용 법령 힌트 (반드시 준수)\n"
        "이 계약은 영업용·상가건물 임대차로 판단됩니다. **상가건물 임대차보호법(상임법)**이 우선 적용됩니다.\n"
        "- 차임 연체 해지: 상임법 제10조의8 — **3기** 연체 시 해지 가능. 2기 연체 해지 조항은 임차인에게 불리(상임법 위반).\n"
        "- 갱신요구권: 임차인은 최초 임대차 기간 포함 10년까지 갱신 요구 가능 (상임법 제10조)\n"
        "- 권리금 회수기회 보호: 상임법 제10조의4\n"
        "- 차임 증액: 약정 차임의 5% 이내 (상임법 제11조)\n"
        "조항 내용이 위 법률 기준과 동일하면 위험으로 평가하지 마세요. 주택임대차보호법(주임법, 2기 기준)은 **적용되지 않습니다**.\n"
    ),
}

RISK_TYPES = {
    "lease": ["보증금_미반환_위험", "일방적_계약해지", "수선의무_전가", "원상복구_과다", "차임증액_무제한", "권리제한", "위약금_과다", "묵시적_갱신_배제"],
    "sales": ["하자담보_면제", "일방적_계약해제", "위약금_과다", "소유권이전_지연", "비용부담_전가", "권리하자_미고지", "계약금_과다", "매수인_권리제한"],
    "employment": ["임금_부당", "부당해고", "경업금지_과다", "위약금_과다", "근로시간_위반", "연차_미보장", "퇴직금_미지급", "근로자_권리제한"],
    "service": ["대금지급_지연", "일방적_사양변경", "하자담보_과다", "위약금_과다", "검수_불공정", "지식재산권_부당양도", "하도급법_위반", "수급인_권리제한"],
    "loan": ["이자_초과", "지연손해금_과다", "일방적_기한이익상실", "보증인_보호위반", "담보_과다", "중도상환_제한", "채권자_일방변경", "차주_권리제한"],
}

NO_REFERENCE_TEXT = {
    "lease": "일반 임대차보호법 원칙에 기반하여 분석.",
    "sales": "일반 민법(매매) 원칙에 기반하여 분석.",
    "employment": "일반 근로기준법 원칙에 기반하여 분석.",
    "service": "일반 민법(도급) 및 하도급거래 공정화에 관한 법률 원칙에 기반하여 분석.",
    "loan": "일반 민법(소비대차) 및 이자제한법 원칙에 기반하여 분석.",
}

REFERENCE_LABEL_GUIDE = (
    "## 참고 자료 라벨 안내 (반드시 숙지)\n"
    "- [법률] : 법률 본문 — 가장 강한 근거. 조문 번호·수치 인용 시 이 라벨의 내용만 사용\n"
    "- [판결문]: 법원 판결 사례 — 유사 사실관계의 판단 참고\n"
    "- [약관-불리]: 을(약자측: 임차인/근로자/매수인)에게 **불리한** 약관 사례 — 본 계약 조항이 이와 유사하면 **안전 신호가 아니라 위험 신호**\n"
    "- [약관-유리]: 을(약자측)에게 유리한 약관 사례\n"
)

# --- hand-kept tables -----------------------------------------------------------------

CONTRACT_TYPES = [  # (key, name, protected party), in declared order
    ("lease", "임대차 계약", "임차인(세입자)"),
    ("sales", "매매 계약", "매수인(구매자)"),
    ("employment", "근로 계약", "근로자(직원)"),
    ("service", "용역·도급 계약", "수급인(용역 수행자)"),
    ("loan", "금전소비대차 계약", "차주(돈을 빌리는 사람)"),
]

SUMMARY_TYPE_LABELS = {"lease": "임대차계약", "sales": "매매계약", "employment": "근로계약"}

# suffixes tried longest first; the stem must keep at least two characters
PARTICLES = [
    "으로서", "으로써", "에게서", "에서는", "에서도", "까지는",
    "로서", "로써", "에게", "한테", "까지", "부터", "이나", "에서",
    "으로", "이다", "한다", "된다", "했다", "하다", "되다", "이며",
    "으며", "처럼", "보다", "마저", "라도", "에도",
    "은", "는", "이", "가", "을", "를", "의", "에", "도", "만",
    "과", "와", "나", "로", "며",
]

SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".hwp", ".hwpx"]
EXPORT_FORMATS = ["docx", "pdf", "hwpx"]

CLAUSE_FILE_TOPICS = [  # (file name part, contract type, topic), first match wins
    ("임대차", "lease", "임대차_약관"),
    ("매매계약", "sales", "매매_약관"),
]
JUDGMENT_TOPICS = {"lease": "임대차_판결", "sales": "매매_판결"}

LAW_FILES = [("법률.md", "법률"), ("시행령.md", "시행령"), ("시행규칙.md", "시행규칙")]
CIVIL_CODE = "민법"
ACT_KIND = "법률"
IN_FORCE = "시행"
CIVIL_DIR = "민사"
PRECEDENT_DIRS = ["민사", "일반행정"]
STANDARD_TERMS_DIR = "약관"
PRECEDENT_SECTIONS = ["판시사항", "판결요지", "참조조문", "참조판례", "판례내용"]

# source -> category used for ranking; anything else is "other"
RANK_CATEGORY = {
    "law": "law",
    "민법": "law",
    "주택임대차보호법": "law",
    "상가건물임대차보호법": "law",
    "근로기준법": "law",
    "근로자퇴직급여보장법": "law",
    "이자제한법": "law",
    "대부업법": "law",
    "보증인보호특별법": "law",
    "하도급거래공정화법": "law",
    "약관규제법/판례": "law",
    "precedent_kr": "judgment",
    "aihub_판결문": "judgment",
    "판례/실무": "judgment",
    "aihub_약관": "clause",
    "실무": "clause",
}
# source -> category used for reporting; anything else is "law"
REPORT_CATEGORY = {
    "precedent_kr": "judgment",
    "aihub_판결문": "judgment",
    "판례/실무": "judgment",
    "aihub_약관": "clause",
    "약관규제법/판례": "clause",
    "실무": "clause",
}
CATEGORY_ORDER = {"law": 0, "judgment": 1, "clause": 2, "other": 3}
CATEGORY_WEIGHT = {"law": 3.0, "clause": 0.6}
CATEGORY_QUOTA = [("law", 2), ("judgment", 2), ("clause", 1)]
RRF_K = 60
POOL_MIN = 20
TOP_K = 5
BM25_SCALE = 8.0
BM25_CAP = 0.92
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

SOURCE_PRIORITY = {"law": 1, "precedent_kr": 2}
AIHUB_PREFIX, AIHUB_PRIORITY, DEFAULT_PRIORITY = "aihub", 3, 0

SEVERITY = ["high", "medium", "low", "safe"]
RISK_LABELS = {"high": "고위험", "medium": "중위험", "low": "저위험", "safe": "안전"}

# clause header of a contract; the look-ahead keeps references such as "제3조를" out
CLAUSE_HEADER = (
    r"^\s*(제\s*\d+\s*조(?:의\s*\d+)?(?:\s*[\(\[][^)\]]*[\)\]])?)"
    r"(?!\s*(?:를|을|은|는|이|가|의|와|과|도|만|에|에서|에게|로|으로|부터|까지|마저|조차|라|라는|라고|보다))"
)
CLAUSE_NUMBER = r"^제\s*(\d+)\s*조"
SPECIAL_HEADER = (
    r"^\s*[\[\(<【※■◆●▶▷□■]?\s*"
    r"(특약\s*사항|특별\s*약정|추가\s*특약|기타\s*특약|특약)"
    r"\s*[\]\)>】]?\s*[:：]?\s*$"
)
SPECIAL_END = (
    r"^\s*(임\s*대\s*인|임\s*차\s*인|매\s*도\s*인|매\s*수\s*인|"
    r"사\s*용\s*자|근\s*로\s*자|발\s*주\s*자|수\s*급\s*인|대\s*주|차\s*주|"
    r"\d{4}\s*년\s*\d{1,2}\s*월|계\s*약\s*일|체\s*결\s*일|작\s*성\s*일)"
)
SPECIAL_ITEM = r"^\s*(?:\d{1,2}\s*[\.\)]|[①-⑳]|[㈀-㈎]|[가-힣]\s*[\.\)]|[-•*]\s+)\s*"
SPECIAL_TITLE = "특약사항"
SPECIAL_MARK = "특약"
CIRCLED = r"[①-⑮]"
NUMBERED_ITEM = r"(?:^|\n)\s*\(?\d{1,2}[.)]\s+"
EXPANSION_LABEL = "\n[검색키워드] "
EXPANSION_THRESHOLD = 100

LAW_ARTICLE_HEADER = r"^#####\s+제(\d+)조(?:의(\d+))?\s*\(([^)]*)\)?"
ARTICLE_NUMBER = r"제\s*(\d+)\s*조(?:의\s*(\d+))?"
HIT_HEADER_LABEL = r"^\[[^\]]+\]\s*[^\n]+\n"
HIT_INLINE_HEADER = r"^[가-힣A-Za-z·\s]+\s*제\s*\d+\s*조(?:의\s*\d+)?\s*\([^)]*\)\s*:?\s*"
HIT_MARKDOWN = r"\*+|#+|`+|[①-⑳㈀-㈎]"
CORPUS_HEADER_LABEL = r"^\[(?:법률|판례)\][^\n]*\n"

REFERENCE_TAG = r"^\s*\[([^\]]{1,12})\]\s*"
REFERENCE_SECTIONS = [
    "판시사항", "판결요지", "참조조문", "참조판례",
    "기초사실", "사실관계", "판결주문", "이유",
    "판단근거", "관련법령", "관련 조문", "조문내용",
]
SUMMARY_LABEL = r"^\s*■\s*(.+?)\s*$"

RULE_CONFIDENCE = 0.95
FAILURE_CONFIDENCE = 0.3
DEFAULT_CONFIDENCE = 0.5
HEAD_ONLY_CONFIDENCE = 0.7
MIN_RISK_TYPE_SIMILARITY = 0.4
SAFE_DEFAULT_EXPLANATION = "해당 조항은 법률상 일반적인 내용으로, 특별한 위험 요소가 없습니다."
HIGH_SUGGESTION = "해당 조항 삭제 또는 법정 기준에 맞게 재협상 필요"
HEAD_ONLY_EXPLANATION = "[JSON 잘림 — 최소 정보만 복구]"
FAILURE_EXPLANATIONS = {
    "timeout": "[분석 실패] LLM 응답 타임아웃. 수동 검토가 필요합니다.",
    "empty": "[분석 실패] LLM이 빈 응답을 반환했습니다. 수동 검토가 필요합니다.",
    "parse_failed": "[분석 실패] LLM 응답을 JSON으로 해석할 수 없습니다. 수동 검토가 필요합니다.",
}
MODEL_ERROR_EXPLANATION = "[분석 오류] LLM 호출 중 오류가 발생했습니다: {error}. 수동 검토가 필요합니다."
MISSING_EXPLANATION = "[분석 실패] 분석 파이프라인에서 이 조항이 누락되었습니다. 수동 검토가 필요합니다."

PARTIES_TEXT = (
    "## 당사자 역할 정의 (반드시 준수)\n"
    "이 계약서에서 '갑'은 {a}이고, '을'은 {b}입니다.\n"
    "조항 본문에 '갑', '을' 이 등장하면 위 정의를 그대로 적용하여 해석하세요. "
    "갑/을의 역할을 바꿔 해석하거나 혼동하지 마세요."
)
PARTY_SYMBOLS = ("갑", "을")
NO_REWRITE_REFERENCES = "(참고 자료 없음 — 일반 법리에 따라 작성)"
NO_RISK_DETAIL = "- (구체적 위험 설명 없음 — 일반적인 균형 조정 수정안 작성)"
NO_RISKY_CLAUSES = "(위험 조항 없음)"
NO_SAFE_CLAUSES = "(안전 조항 없음)"

EXPORT_TITLE = "권고 수정안 반영 계약서"
EXPORT_NOTICE = (
    "본 문서는 AI 분석 결과를 바탕으로, 위험 요소가 식별된 조항에 대해 "
    "표준약관·관련 법률을 근거로 한 권고 수정안을 함께 표기한 참고용 계약서입니다. "
    "법적 효력은 없으며, 실제 계약 체결 전 전문가 검토를 권장합니다."
)
ORIGINAL_LABEL = "[원문]"
USER_REWRITE_LABEL = "[수정안 (사용자)]"
MODEL_REWRITE_LABEL = "[권고 수정안]"
EXPORT_SUFFIX = "_권고수정안."
