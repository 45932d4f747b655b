"""Documents of our own making for the tests."""

ISA = "ISA*00*          *00*          *ZZ*SENDERID       *ZZ*RECEIVERID     *260601*1200*^*00501*{ctl:>09}*0*T*:~\n"


def doc(kind: str, ctl: int, *segments: str, count: int | None = None, st02: str = "0001", se02: str = "0001") -> str:
    n = len(segments) + 2 if count is None else count
    body = "".join(s + "~\n" for s in segments)
    return ISA.format(ctl=ctl) + f"GS*XX*S*R*20260601*1200*{ctl}*X*005010~\nST*{kind}*{st02}~\n{body}SE*{n}*{se02}~\nGE*1*{ctl}~\nIEA*1*{ctl:>09}~\n"


CLAIM = doc(
    "837", 11, "BHT*0019*00*A*20260601*1200*CH", "HL*1**20*1", "PRV*BI*PXC*TAX1", "NM1*85*2*CLINIC*****XX*P1", "HL*2*1*22*0", "SBR*P*18*GRP1******CI", "NM1*IL*1*DOE*JO****MI*M1", "DMG*D8*19800101*F",
    "CLM*C1*300.00***11:B:1*Y*A*Y*I", "REF*D9*R1", "HI*ABK:I639*ABF:R42", "NM1*82*1*ROE*AL****XX*P2", "PRV*PE*PXC*TAX2", "LX*11", "SV1*HC:11111:25:59*100.00*UN*1***1:2", "DTP*472*D8*20260601", "LX*12", "SV1*HC:22222*200.00*UN*2", "DTP*472*D8*20260602",
)
PAYMENT = doc(
    "835", 12, "BPR*I*180.00*C*ACH************20260605", "TRN*1*E1*15", "N1*PR*PLAN*XV*PAY1", "CLP*C1*1*300.00*180.00*20.00*12*PC1*11*1", "NM1*QC*1*DOE*JO****MI*PT1",
    "SVC*HC:22222*200.00*150.00**2", "DTM*472*20260602", "CAS*CO*45*30.00**1*253*5.00", "CAS*PR*3*15.00", "SVC*HC:33333*50.00*30.00**1", "CAS*CO*45*20.00", "CAS*OA*23*1.00",
)
ENROL = doc("834", 13, "BGN*00*R*20260601", "INS*Y*18*021*28*A", "NM1*IL*1*DOE*JO****MI*M1", "DTP*348*D8*20260101", "HD*021**HLT*GOLD*EMP", "INS*N*19*024*28*T", "NM1*IL*1*DOE*KIM****MI*M2", "REF*0F*M1", "DTP*349*D8*20261231")
ASK = doc("270", 14, "BHT*0022*13*Q1*20260601*0800", "HL*1**20*1", "NM1*PR*2*PLAN*****PI*PAY1", "HL*2*1*22*0", "NM1*IL*1*DOE*JO****MI*M1", "DTP*291*D8*20260603", "EQ*30")
ANSWER = doc("271", 15, "BHT*0022*11*Q1*20260601*0801", "HL*1**20*1", "NM1*PR*2*PLAN*****PI*PAY1", "NM1*ZZ*1*SOMEONE*****ZZ*X9", "HL*2*1*22*0", "NM1*IL*1*DOE*JO****MI*M1", "DMG*D8*19800101*F", "DTP*291*D8*20260603", "EB*1*IND*30*HM*GOLD", "DTP*346*D8*20260101", "EB*C*IND*98***29*40.00", "DTP*347*D8*20261231")


def documents(spark, *rows):
    """rows: (name, type, text)."""
    return spark.createDataFrame([(n, k, i, t) for i, (n, k, t) in enumerate(rows)], "source_file string, source_transaction string, input_ordinal int, text string")


def everything(spark):
    return documents(spark, ("a.edi", "837", CLAIM), ("b.edi", "835", PAYMENT), ("c.edi", "834", ENROL), ("d.edi", "270", ASK), ("e.edi", "271", ANSWER))
