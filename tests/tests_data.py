"""Edge rows every detector meets."""

EDGE_ROWS = [
    "", "   ", "a@b.com", "x a@b.com", "a@b.com,c@d.org", "\U0001f600 10.0.0.1 \u00e9 10.0.0.2", "caf\u00e94111 1111 1111 1111",
    "\u00e9x@y.com y\u00e9@z.com", "[EMAIL] [NAME] 12", "a\u00a010.0.0.1\u00a0b", "line\r\nline 10.0.0.1\r\nend",
    "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "S/N: AB12345678 Serial: XYZ987654321",
    "sha1 24be64439e3e49cf46b2d7c90f3602a3d0b907ff; recovery key: ABC-DEF-1234567",
    "barcode Tag(E28038212000682301AB8A76)", "INC0012345 RITM1234567 abc-12 ES319725 RFC # 25224330 CR-12345678 PR:433072",
    "as per RFC 25655813, install avaya work space, 25648792", "2743428-Zscaler tool", "Ticket. No 104630759, CS ticket 105620792",
    "CORP\\jdoe S-1-5-21-1-2-3 joe@dc.local svc.app1 NT71853 sa1234567abc", "C:\\Users\\joe\\x",
    "TCB4/ODC1/WSN/100 S2-6F-Z03-056 12F ODC 3 @SFC Z10, Seat No 20 SP2_9F_ODC8 IND_DEL_YAM_T5_11_UPS A1F 102",
    "floor 3, desk 12A badge no 12345 ext. 4321 did: +1 234 567 8901 apac india.tcs.com", "dm with joe.doe now",
    "user joe logged in; login for user ann@x", "teamviewer id: 123 456 789 anydesk 123-456-789 rdp id host-77",
    "subscription id: 12345678-12ab-34cd-56ef-123456789012 arn:aws:s3::123456789012:b/x aws account 123456789012 gcp project my-proj-12",
    "/subscriptions/12345678-12ab-34cd-56ef-123456789012/resourceGroups/rg/providers/x.y/z",
    "ABCDE-FGHIJ-KLMNO-PQRST product key: ABCDE-FGHIJ-KLMNO-PQRST-UVWXY ci: SRV1234567",
    "jsessionid=abcdefghijklmnop1234 cookie: a=1 session=xyz; eyJhbGci.eyJzdWIi.c2ln bearer abcdefghijklmnopqrstuvwx",
    "jdbc: url password=abc; uid=a; x=1; pwd=b mongodb+srv://u:p@h/x", "vpn user: joe api key ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ifsc HDFC0001234 iban GB82 WEST 1234 5698 7654 32 swift: HDFCINBB routing 021000021 a/c: 123456789",
    "uan 100123456789 AB/CDE/1234567/123/1234567 policy no: LIC-12345678 dob: 1/2/1990 age 34 yrs born on 3.4.2001",
    "INHYDB03 INSZCM12PRI1DB media server INHYDB03 whatsapp mysec dev1", "fe80:0:0:0:1:2:3:4 00-1A-2B-3C-4D-5E 1.2.3.4:80",
    "user@upi abc.def@okicici x@other", "http://a.b/c?d=e <ftp://x.y> https://z", "date 2024-12-25 10:00 3.14 98765 43210",
    "&amp;lt; &#233; &#x1F600; \u2018q\u2019 \ufb01n \u00bd a\u0301 e\u0302\u0301 \u200bzero", "tab\there  and  blanks \n \n\n\n\n end ",
]
